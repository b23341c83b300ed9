"""The flagship: for each file, its colours, what each resolves to, and what a conversion would replace."""

from __future__ import annotations

from pyspark.sql import DataFrame

from colorjobs.operators import batch, mapping, usage


def resolve(tokens: DataFrame, tables: dict[str, DataFrame], active: str, pipeline: str = "grayscale", tasks: int | None = None) -> DataFrame:
    return mapping.merge_with_semantic(usage.usage_counts(tokens, tasks), tables["global_map"], tables["slots"], tables["themes"], active,
        tables["overrides"], pipeline)


def convert(svgs: DataFrame, tokens: DataFrame, tables: dict[str, DataFrame], active: str, pipeline: str = "grayscale", **select) -> dict[str, DataFrame]:
    """Selection, safety warnings, recoloured documents and report of one run. Documents are joined last, to small maps."""
    resolved = resolve(tokens, tables, active, pipeline)
    files = mapping.library(svgs, tables["illustrations"], tables["overrides"])
    own = tables["overrides"].where(f"pipeline = '{pipeline}'")
    chosen = batch.select_for_convert(files, mapping.unmapped_colors(resolved), own, **select)
    merged = resolved.where("layer != 'none'").select("file", resolved.hex.alias("source"), "target")
    go = chosen.where("convert").select("file")
    return {"selection": chosen, "safety": mapping.print_safety(merged.join(go, "file", "left_semi")), "report": mapping.recolor_report(resolved),
        "documents": batch.recolor_svgs(svgs.join(go, "file", "left_semi"), merged)}
