"""Searches and retention-time alignment over streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from ionweave.config import Config
from ionweave.operators.scoring import align_history
from ionweave.plans.search import search_index
from ionweave.tables import temporary

HISTORY = 250


def search_stream(scans: DataFrame, index: str, cfg: Config, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "PI") -> StreamingQuery:
    """Searches each micro-batch of a stream of spectra in a stored index; results don't depend on how it is cut."""

    def batch(df: DataFrame, number: int) -> None:
        with temporary():  # what a batch's search writes goes with it
            sink(search_index(df.sparkSession, df, index, cfg, mode), number)

    return scans.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def search_one(spark: SparkSession, index: str, cfg: Config, precursor_mz: float, charge: int, peaks: list[tuple[float, float]], top: int = 1) -> list:
    """One spectrum at a time, as instruments ask: the best ``top`` matches."""
    from ionweave.config import PROTON
    from ionweave.sources.readers import SPECTRA

    row = ("live", 1, 2, 0.0, None, None, precursor_mz, None, None, [(charge, precursor_mz * charge - PROTON * (charge - 1))], [(float(m), float(i)) for m, i in peaks])
    with temporary():
        return search_index(spark, spark.createDataFrame([row], SPECTRA), index, cfg).where(f"num <= {int(top)}").orderBy("num").collect()


def align_stream(matches: DataFrame, history: int = HISTORY) -> DataFrame:
    """Predicted reference time of each match of a stream (run, query_rt, ref_rt), from its run's last ``history`` matches.

    State is the run's history; rows of a micro-batch are taken in order of query_rt.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        x, y = (list(v) for v in state.get) if state.exists else ([], [])
        rows = pd.concat(list(frames)).sort_values(["query_rt", "ref_rt"])
        out = []
        for q, r in zip(rows["query_rt"], rows["ref_rt"]):
            out.append(align_history(x, y, q, r))
            x, y = [*x, q][-history:], [*y, r][-history:]
        state.update((x, y))
        yield pd.DataFrame({"run": key[0], "query_rt": rows["query_rt"], "ref_rt": rows["ref_rt"], "predicted": out})

    return matches.groupBy("run").applyInPandasWithState(update, "run string, query_rt double, ref_rt double, predicted double", "x array<double>, y array<double>", "append", "NoTimeout")
