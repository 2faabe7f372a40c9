"""The labelled rows that train the personal-data tagger: spans stand as [kind:text]."""

EXAMPLES = """\
Call [phone:(212) 555-0143] before noon
call [phone:(415) 555-9922] or write to [email:ann.lee@mail.example.org]
phone [phone:(303) 555-7781], ask for Jo
tel [phone:(617) 555-2040] or fax [phone:(617) 555-2041]
the office [phone:(808) 555-1188] is open on Monday
and then [phone:(509) 555-6021] the rest of it
of them [phone:(702) 555-3390].
In the end [phone:(913) 555-4412] it was
[phone:(270) 555-8034] is my number
Reach us at [phone:646-555-0199] today
mobile: [phone:718-555-2323]
cell [phone:206.555.7788] work [phone:206.555.7789]
His number is [phone:404 555 8181] ok
ring [phone:502-555-1029] ext 4
Phone: [phone:+1 (312) 555-7070]
call [phone:+44 20 7946 0958] in London
tel. [phone:+49 30 901820] Berlin
Contact [phone:+33 1 42 68 53 00] for more
fax [phone:+1-800-555-0111]
number [phone:800-555-0147] is free of charge
mail to [email:kim.04@mail3.example.com] please
[email:support@example.net] answers all
write [email:a_b+c@sub.example.co.uk], thanks
email: [email:x99@host1.example.com].
contact [email:first-last@example.org] or [email:other.12@mail7.example.com]
the list [email:bob.77@mail2.example.com] and so on
server [ip:10.0.0.12] is down
ip [ip:192.168.1.254] and host [ip:172.16.4.9]
from [ip:45.67.89.101] to [ip:45.67.89.102] the
login by [ip:203.0.113.77] failed
at [ip:8.8.8.8] again
card [card:4111111111111111] was charged
visa [card:4111 1111 1111 1111] expires
pay with [card:5500-0000-0000-0004] now
the card [card:340000000000009] and the
of [card:4012888888881881] in
credit card number [card:6011 0009 9013 9424] on file
On 2021-03-04 we met at 10:30
between 1998 and 2004 the price rose by 12.5 percent
Version 2.0 of the Apache License
GNU General Public License, version 3
Licensed under CC BY-NC 4.0
see page 123, lines 45-67
order 48291 shipped on 03/04/2022
invoice no 2023-000187 total 1,250.00
ISBN 978-3-16-148410-0 second edition
population 8336817 in 2020
token = "3f9a1c77e0b4d2a86c55"
password=ab12cd34ef56ab78cd
key AKIA12EXAMPLE345678 was removed
commit 9fceb02d0ae598e95dc970b74767f19372d61af8
chapter 7, section 3.1.4, figure 12
costs 300 dollars or 250 euros
the 2 of 3 and 10 of 12
room 555, floor 20
lat 52.5200 lon 13.4050
id 1234567890 was not found
Copyright 2019 all rights reserved
(c) 2020 the authors
score 21-14 and 35-28
ratio 16:9 at 60 fps
(1999) the first of 555 items
pages (234) and (567) were lost
about (120) 45 of them
@home with 3 others
follow @news2 and @sports
a @ b gives 12
model X200 at 4.5 GHz
row 15 | 22 | 31 | 48
mail 24 letters by hand
phone 3 is broken
card 12 of 52
call 2 friends
"""


def parse(examples: str = EXAMPLES) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """(text, [(kind, start, end)]) of every row."""
    out = []
    for row in examples.splitlines():
        text, spans, at = "", [], 0
        while (i := row.find("[", at)) >= 0:
            j = row.index("]", i)
            kind, _, inner = row[i + 1 : j].partition(":")
            text += row[at:i]
            spans.append((kind, len(text), len(text) + len(inner)))
            text += inner
            at = j + 1
        out.append((text + row[at:], spans))
    return out
