"""The corpus queries by name, each with its SQL oracle where SQL can express it."""

from . import bpe, decontaminate, linedup, merkle, minhash, periodic, pii, quality, sharding, subspace, token_count, toxicity, warc

QUERIES = {
    "op1_near_dedup": minhash.op1_near_dedup,
    "op2_line_dedup": linedup.op2_line_dedup,
    "op3_shards": sharding.op3_shards,
    "op4_pii": pii.op4_pii,
    "op5_warc": warc.op5_warc,
    "op6_quality": quality.op6_quality,
    "op7_token_counts": token_count.op7_token_counts,
    "op8_decontamination": decontaminate.op8_decontamination,
    "op9_bpe": bpe.op9_bpe,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_periodic_runs": periodic.op12_periodic_runs,
    "op13_embedding_dedup": subspace.op13_embedding_dedup,
}
ORACLES: dict[str, str] = {
    "op1_near_dedup": minhash.OP1_SQL,
    "op2_line_dedup": linedup.OP2_SQL,
    "op5_warc": warc.OP5_SQL,
    "op8_decontamination": decontaminate.OP8_SQL,
    "op11_merkle_manifest": merkle.OP11_SQL,
    "op13_embedding_dedup": subspace.OP13_SQL,
}
