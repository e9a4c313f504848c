"""Documents for the brute-force tests: the smallest test table and rows that are odd in one way each."""

from __future__ import annotations

import duckdb
import pyarrow as pa

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents() -> list[tuple]:
    return duckdb.sql(f"SELECT doc_id, text, lang, source, n_chars FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


def benchmark() -> list[tuple]:
    return duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet' ORDER BY item_id").fetchall()


def odd(at: int = 900_000) -> list[tuple]:
    """Nulls in each column, empty and blank texts, copies, repeated rows, marks only, and a very long text."""
    words = [f"w{i % 977}x{i % 31}" for i in range(60_000)]
    some = " ".join(words[:200])
    texts = [None, "", " \t\n", "...", "a", some, some, " ".join(words), "ünï " * 40, "\U0001f600 　 \x85 x"]
    rows = [(at + i, t, "en", "src1", len(t or "")) for i, t in enumerate(texts)]
    rows += [(at + 50, some + " tail", None, None, None), (at + 50, some + " tail", None, None, None), (None, some, "fr", "src2", 5), (None, None, None, None, None)]
    return rows


def frame(spark, rows: list[tuple], schema: str = DOCS, parts: int = 5):
    return spark.createDataFrame(rows, schema).repartition(parts)


def with_clashes(df, names: str):
    """Adds columns whose names the operator uses itself."""
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("clash").alias(n) for n in names.split() if n not in df.columns])


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def table(rows: list[tuple], names: list[str]) -> pa.Table:
    return pa.table({n: [r[i] for r in rows] for i, n in enumerate(names)})
