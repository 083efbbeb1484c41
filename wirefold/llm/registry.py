"""The queries of this subpackage and their oracles, by registered name."""

from __future__ import annotations

import corpus_pipeline
from wirefold.llm import decontam, jaccard_join, pieces, pii, quality_rules, sharding, token_counts, toxicity, url_filter, warc
from wirefold.llm.common import read_table


def queries() -> dict:
    docs = lambda f: lambda spark, d: f(read_table(spark, d, "documents"))
    return {
        "pipeline": corpus_pipeline.run,
        "op1_pii": docs(pii.op1),
        "op2_warc": lambda spark, d: warc.op2(read_table(spark, d, "pages")),
        "op3_template_decontamination": lambda spark, d: decontam.contaminated(read_table(spark, d, "documents"), read_table(spark, d, "benchmark")),
        "op4_jaccard_join": docs(jaccard_join.op4),
        "op5_pieces": docs(pieces.op5),
        "op6_size_tiered_shards": docs(sharding.op6),
        "op7_token_counts": docs(token_counts.op7),
        "op8_toxicity": lambda spark, d: toxicity.op8(read_table(spark, d, "documents"), read_table(spark, d, "labels")),
        "op9_url_filter": lambda spark, d: url_filter.op9(read_table(spark, d, "pages")),
        "op10_quality_rules": docs(quality_rules.op10),
        "quality_ablation": docs(quality_rules.ablation),
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": warc.OP2_SQL, "op6_size_tiered_shards": sharding.OP6_SQL, "op10_quality_rules": quality_rules.OP10_SQL, "quality_ablation": quality_rules.ABLATION_SQL}
