"""Document pipelines: chunks, redaction with a map, layout lines, compact object notation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import spans
from tidemark.functions import text as tx


def cut(text: str, most: int = 800, least: int = 200) -> list[tuple[int, int, str]]:
    """``(start, end, heading)`` of windows of a text.

    A window ends at its last blank line after ``least`` characters, else after
    ``most``; the heading is the last line that began with ``#`` before its end.
    """
    out, at, heading = [], 0, ""
    while at < len(text):
        end = min(at + most, len(text))
        if end < len(text):
            blank = text.rfind("\n\n", at + least, end)
            end = blank + 2 if blank >= 0 else end
        for line in text[at:end].split("\n"):
            if line.startswith("#"):
                heading = line.lstrip("#").strip()
        out.append((at, end, heading))
        at = end
    return out


def chunks(docs: DataFrame, key: str, column: str, most: int = 800, least: int = 200) -> DataFrame:
    """``(key, chunk, start, end, heading, body, chunk_hash)`` of whole documents."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (k, i, a, b, h, body[a:b])
                for k, body in zip(batch["key"], batch["body"])
                if isinstance(body, str)
                for i, (a, b, h) in enumerate(cut(body, most, least))
            ]
            yield pd.DataFrame(rows, columns=["key", "chunk", "start", "end", "heading", "body"])

    rows = docs.select(F.col(key).alias("key"), F.col(column).alias("body"))
    schema = f"key {kind}, chunk int, start int, end int, heading string, body string"
    out = rows.mapInPandas(run, schema).withColumnRenamed("key", key)
    return out.withColumn("chunk_hash", F.sha2("body", 256))


def redaction(body: Column, patterns: Sequence[tuple[str, str]]) -> Column:
    """``struct(body, tokens)``: a text with every match of named patterns as ``[name:n]``, and what each one stood for.

    Overlapping matches are one range, named after the one that begins first; equal values share a token, which
    has the number of the value in order of appearance. A null text is the empty one.
    """
    body = F.coalesce(body, F.lit(""))

    def tokens(ranges: Column) -> Column:
        def known(values: Column) -> Column:
            # A token has the name of the first range with its value.
            token = lambda v: F.concat_ws(":", F.get(F.filter(ranges, lambda r: r["value"] == v), F.lit(0))["kind"], F.array_position(values, v))
            entries = F.transform(values, lambda v: F.struct(token(v).alias("token"), v.alias("value")))

            def shown(named: Column) -> Column:
                own = F.transform(
                    ranges,
                    lambda r: F.struct(
                        r["start"].alias("start"), r["end"].alias("end"),
                        F.concat(F.lit("["), F.get(named, (F.array_position(values, r["value"]) - 1).cast("int"))["token"], F.lit("]")).alias("token"),
                    ),
                )
                return F.struct(spans.bound(own, lambda x: spans.with_tokens(body, x)).alias("body"), F.map_from_entries(named).alias("tokens"))

            return spans.bound(entries, shown)

        return spans.bound(F.array_distinct(F.transform(ranges, lambda r: r["value"])), known)

    valued = lambda ranges: F.transform(
        ranges,
        lambda r: F.struct(
            r["start"].alias("start"), r["end"].alias("end"), r["kind"].alias("kind"),
            F.substring(body, r["start"] + 1, r["end"] - r["start"]).alias("value"),
        ),
    )
    return spans.bound(spans.bound(spans.merged(body, patterns), valued), tokens)


def redacted(docs: DataFrame, key: str, column: str, patterns: Sequence[tuple[str, str]]) -> DataFrame:
    """``(key, body, tokens map)`` with every match replaced by a token."""
    return docs.select(key, redaction(F.col(column), patterns).alias("r")).select(key, "r.body", "r.tokens")


def layout_lines(spans: DataFrame, by: str, tolerance: float = 0.6) -> DataFrame:
    """``(by, line, text, kind)`` of word boxes ``(x0, y0, x1, y1, word)``.

    Words whose centres differ by less than a share of the height from the word
    before, going down, are one line; a line with wide gaps is a table row, one
    that begins with a bullet a list item, a tall one a heading.
    """
    rows = spans.withColumn("c", (F.col("y0") + F.col("y1")) / 2).withColumn("h", (F.col("y1") - F.col("y0")).cast("double"))
    down = Window.partitionBy(by).orderBy("c", "x0", "word")
    apart = F.coalesce((F.col("c") - F.lag("c").over(down)) > tolerance * F.col("h"), F.lit(False)).cast("int")
    rows = rows.withColumn("apart", apart)
    rows = rows.withColumn("line", F.sum("apart").over(down.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    usual = rows.groupBy(by).agg(F.percentile("h", 0.5).alias("usual"))
    lines = rows.groupBy(by, "line").agg(
        F.array_sort(F.collect_list(F.struct("x0", "x1", "word"))).alias("words"), F.avg("h").alias("h")
    )
    words = F.transform("words", lambda w: w["word"])
    gaps = F.zip_with(
        F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0))),
        F.slice("words", 1, F.greatest(F.size("words") - 1, F.lit(0))),
        lambda b, a: b["x0"] - a["x1"],
    )
    wide = F.exists(gaps, lambda g: g > 2 * F.col("h")) & (F.size("words") > 2)
    body = F.when(wide, F.array_join(words, " | ")).otherwise(F.array_join(words, " "))
    kind = (
        F.when(wide, "table").when(body.rlike(r"^(?:[-*•]|\d+[.)])"), "list")
        .when(F.col("h") > 1.4 * F.col("usual"), "heading").otherwise("text")
    )
    return lines.join(usual, by).select(by, "line", body.alias("text"), kind.alias("kind"))


def layout_markdown(lines: DataFrame, by: str) -> DataFrame:
    """``(by, markdown)`` of a page's lines: headings marked, table rows between bars, list items and text as they are."""
    shown = F.when(F.col("kind") == "heading", F.concat(F.lit("## "), "text")).when(
        F.col("kind") == "table", F.concat(F.lit("| "), "text", F.lit(" |"))
    ).otherwise(F.col("text"))
    listed = F.array_sort(F.collect_list(F.struct("line", shown.alias("s"))))
    return lines.groupBy(by).agg(F.array_join(F.transform(listed, lambda x: x["s"]), "\n").alias("markdown"))


def injection_report(docs: DataFrame, key: str, column: str) -> DataFrame:
    """``(key, risk, cleaned)``: the share of lines with injected instructions, and the text without them."""
    body = F.col(column)
    return docs.select(key, tx.injection_risk(body).alias("risk"), tx.without_injection(body).alias("cleaned"))
