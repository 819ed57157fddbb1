"""The document pipeline: stages composed as a preset says; nothing runs before a sink does.

Input: documents (doc_id, title, text) and their typed blocks with boxes. Each stage is a function of DataFrames; the
stages that a preset leaves out aren't in the plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fields as V
from ..functions import fixed
from ..functions import text as T
from ..operators import annotations as A
from ..operators import blocks as B
from ..operators import chunks as C
from ..operators import docjson as J
from ..operators import matching as M
from .presets import Preset, preset


def run(docs: DataFrame, blocks: DataFrame, level: str | Preset = "standard", template: M.Template = fixed.TECHNICAL_STANDARD) -> dict[str, DataFrame]:
    """The outputs of the preset by name: docjson, and as asked template, annotations, vectors, chunks, always quality."""
    p = level if isinstance(level, Preset) else preset(level)
    t = F.col("text")
    meta = docs.select("doc_id", "title", V.document_number(t).alias("number"), V.effective_date(t).alias("date"), V.revision(t).alias("revision"), T.document_type(F.lit(None).cast("string"), F.col("title"), F.lit("")).alias("doc_type"))
    sections = B.sessionize(blocks)
    out = {"docjson": J.nest(meta, sections)}
    quality = docs.select("doc_id")
    confidence = F.lit(None).cast("double")
    if p.match_templates:
        exact, fuzzy, position = M.exact_fields(docs, template), M.fuzzy_fields(blocks, template), M.position_fields(blocks, template)
        best = M.best_strategy(M.strategy_scores(docs, exact, fuzzy, position, template))
        out["template"] = best
        quality = quality.join(best.select("doc_id", F.col("confidence").alias("t")), "doc_id", "left")
        confidence = F.when(F.col("t") >= p.threshold, F.col("t")) if p.apply_templates else F.col("t")
    if p.annotate:
        out["annotations"] = A.block_fields(blocks)
    if p.vectorize:
        out["vectors"] = C.vector_chunks(meta, sections)
        out["chunks"] = C.retrieval_chunks(meta, sections)
    note = F.lit(0.8) if p.annotate else F.lit(None).cast("double")
    vector = F.lit(0.95) if p.vectorize else F.lit(None).cast("double")
    out["quality"] = quality.select("doc_id", F.lit(p.level).alias("level"), V.stage_quality(F.lit(0.95), confidence, note, vector, F.lit(True)).alias("quality"))
    return out


def write(outputs: dict[str, DataFrame], path: str) -> None:
    """SNK-4: each output as a table of its own under ``path``; the nested form as JSON lines, rejects beside it."""
    for name, df in outputs.items():
        if name == "docjson":
            J.save(df, f"{path}/docjson").write.mode("overwrite").json(f"{path}/rejected")
        else:
            df.write.mode("overwrite").parquet(f"{path}/{name}")
