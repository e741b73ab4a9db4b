"""Query op6: preference formatting of conversations.

The table holds no rejected answers, so the query makes them: a rejected conversation is the chosen one with its last
assistant turn begun by a refusal.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .preference import paired

REFUSAL = "No. "


def op6_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    last = chosen.groupBy("conv_id").agg(F.max(F.when(F.col("role") == "assistant", F.col("turn"))).alias("last"))
    refuse = (F.col("turn") == F.col("last")) & (F.col("role") == "assistant")
    text = F.when(refuse, F.concat(F.lit(REFUSAL), F.coalesce("text", F.lit("")))).otherwise(F.col("text"))
    rejected = chosen.join(last, "conv_id").select("conv_id", "turn", "role", text.alias("text"))
    both = paired(chosen, rejected)
    flat = lambda side: [F.col(f"{side}.role").alias(f"{side}_role"), F.col(f"{side}.rendered").alias(side), F.col(f"{side}.mask_from").alias(f"{side}_mask_from")]
    return both.select("conv_id", "turn", "k", "part", *flat("chosen"), *flat("rejected"))


QUERIES = {"op6_preference": op6_preference}
ORACLE = {
    "op6_preference": """
WITH l AS (SELECT conv_id, max(CASE WHEN role = 'assistant' THEN turn END) AS last FROM conversations GROUP BY conv_id),
c AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY coalesce(role, ''), coalesce(text, '')) AS INTEGER) AS k, last
  FROM conversations JOIN l USING (conv_id) WHERE turn IS NOT NULL),
p AS (SELECT *, last IS NULL OR turn < last OR (turn = last AND role <> 'assistant' AND k < coalesce((SELECT min(x.k) FROM c x WHERE x.conv_id = c.conv_id AND x.turn = c.last AND x.role = 'assistant'), 1)) AS common FROM c),
s AS (SELECT *, '<|' || role || '|>' || chr(10) AS h, CASE WHEN turn = last AND role = 'assistant' THEN 'No. ' || text ELSE text END AS other FROM p)
SELECT conv_id, turn, k, CASE WHEN common THEN 'prompt' ELSE 'completion' END AS part, role AS chosen_role, h || text || '<|end|>' || chr(10) AS chosen,
  CAST(CASE WHEN NOT common AND role = 'assistant' THEN length(h) ELSE length(h || text || '<|end|>') + 1 END AS INTEGER) AS chosen_mask_from,
  CASE WHEN NOT common THEN role END AS rejected_role, CASE WHEN NOT common THEN h || other || '<|end|>' || chr(10) END AS rejected,
  CASE WHEN NOT common THEN CAST(CASE WHEN role = 'assistant' THEN length(h) ELSE length(h || other || '<|end|>') + 1 END AS INTEGER) END AS rejected_mask_from FROM s
"""
}
