"""The batch pipeline from landed files to derived tables: depth charts, tenures, identities, scores."""

from __future__ import annotations

import glob
import os

from pyspark.sql import DataFrame, SparkSession

from fieldglass.plans import athletic, identity, tenure
from fieldglass.sources.catalog import read_csv, read_seasonal, write_csv


def landed(spark: SparkSession, data_dir: str, name: str, texts: bool = True) -> DataFrame | None:
    """A dataset's file, or its files by season; None if it has not landed. Texts only, unless asked otherwise."""
    whole = f"{data_dir}/nflverse/{name}.csv"
    if os.path.exists(whole):
        return read_csv(spark, whole, infer=not texts)
    paths = glob.glob(f"{data_dir}/nflverse/{name}_[0-9]*.csv")
    return read_seasonal(spark, paths) if paths else None


def depth_charts(spark: SparkSession, data_dir: str, out: str) -> dict[str, str]:
    raw = tenure.read_depth_charts(spark, f"{data_dir}/nflverse/depth_charts.csv", tenure.WIDTH)
    legacy, modern = tenure.split_depth_charts(raw)
    paths = {"depth_charts_legacy": legacy, "depth_charts_modern": modern}
    for name, df in paths.items():
        write_csv(df, f"{out}/{name}")
    return {name: f"{out}/{name}" for name in paths}


def executive_tenures(spark: SparkSession, data_dir: str, out: str) -> DataFrame:
    codes = read_csv(spark, f"{data_dir}/reference/team_code_mapping.csv", infer=False)
    rows = tenure.tenures(tenure.read_executives(spark, f"{data_dir}/raw/executives"), codes)
    write_csv(rows, f"{out}/gm_tenures")
    return rows


def identities(spark: SparkSession, data_dir: str, out: str) -> DataFrame:
    """The mapping table, and every landed dataset with the player's id; returns how many rows of each found one."""
    need = {n: landed(spark, data_dir, n) for n in ("players", "combine", "draft_picks")}
    if missing := [n for n, df in need.items() if df is None]:
        raise FileNotFoundError(", ".join(missing))
    write_csv(identity.mapping_table(identity.unified_players(**need)), f"{out}/yamplayer_mapping")
    mapping = read_csv(spark, f"{out}/yamplayer_mapping", infer=False)
    found = {n: df for n in identity.HYDRATORS if (df := landed(spark, data_dir, n)) is not None}
    hydrated = identity.hydrate_all(found, mapping)
    for name, df in hydrated.items():
        df.write.mode("overwrite").parquet(f"{out}/{name}")
    return identity.match_report({n: spark.read.parquet(f"{out}/{n}") for n in hydrated})


def scores(spark: SparkSession, data_dir: str, out: str, current_year: int) -> DataFrame:
    rows = athletic.athletic_scores(read_csv(spark, f"{data_dir}/nflverse/combine.csv"), current_year)
    rows.write.mode("overwrite").parquet(f"{out}/yas_complete")
    return spark.read.parquet(f"{out}/yas_complete")


def process(spark: SparkSession, data_dir: str, out: str, current_year: int) -> dict[str, str]:
    """All steps whose inputs have landed; step -> done, skipped or its error. A failing step stops no other."""
    steps = {
        "depth_charts": (f"{data_dir}/nflverse/depth_charts.csv", lambda: depth_charts(spark, data_dir, out)),
        "tenures": (f"{data_dir}/raw/executives", lambda: executive_tenures(spark, data_dir, out)),
        "identities": (f"{data_dir}/nflverse/players.csv", lambda: identities(spark, data_dir, out)),
        "scores": (f"{data_dir}/nflverse/combine.csv", lambda: scores(spark, data_dir, out, current_year)),
    }
    report = {}
    for name, (needs, run) in steps.items():
        if not os.path.exists(needs):
            report[name] = "skipped"
            continue
        try:
            run()
            report[name] = "done"
        except Exception as e:  # noqa: BLE001 - reported to the caller
            report[name] = f"{type(e).__name__}: {e}"
    return report


__all__ = ["depth_charts", "executive_tenures", "identities", "landed", "process", "scores"]
