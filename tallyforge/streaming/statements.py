"""Statement lines to transactions as they arrive: what a statement's lines leave behind is kept in a state store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import predicates
from ..operators import lines as batch

#: Sections as far as a line's meaning depends on them: none, credits or debits, and checks.
VARIANTS = (None, "credit", "check")
#: Spark keeps state of this kind in its RocksDB store only.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = "section string, suppressed boolean, day date, hinted boolean, ord long"
_ROW = "statement_id string, ord int, date date, description string, amount double, check_no string, section string"


def statement_lines(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """Lines of JSON records (statement_id, line_no, text) as files of them arrive, at most so many files a batch."""
    return spark.readStream.schema("statement_id string, line_no int, text string").option("maxFilesPerTrigger", files).json(folder)


class Gathering(StatefulProcessor):
    """Rows of a statement from its events: section, date and waiting lines are state.

    A batch brings the lines of a statement that follow those of the batches before, in any order among themselves; they are
    sorted in memory, so that a batch has to be bounded (statement_lines does). `close` ends a statement and its state.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.scan = handle.getValueState("scan", _STATE)
        self.waiting = handle.getListState("waiting", "body string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        found = pd.concat(list(rows)).sort_values("line_no", kind="stable")
        found = found.astype(object).where(found.notna(), None)
        section, suppressed, day, hinted, ord_ = self.scan.get() if self.scan.exists() else (None, False, None, False, 0)
        waiting, out = [r[0] for r in self.waiting.get()], []

        def row(date, text: str, amount: float | None = None, number: str | None = None) -> None:
            nonlocal ord_
            ord_ += 1
            out.append((key[0], ord_, date, text, amount, number, section))

        def end() -> None:
            nonlocal waiting, hinted
            text = " ".join(waiting).strip()
            if text and (hinted or day or section):
                row(day, text)
            waiting, hinted = [], False

        for e in found.itertuples(index=False):
            if e.variant != (VARIANTS.index("credit" if section == "debit" else section)):
                continue
            if e.heading == "close":
                end()
                section, suppressed, day, ord_ = None, False, None, 0
            elif e.heading is not None:
                end()
                suppressed = e.heading == "end"
                section = None if suppressed else e.heading
                # Lines after a heading are read by the new section: the variant is looked up for each.
            elif not suppressed and e.event != "line":
                end()
                row(e.date or (day if e.event == "register" else None), e.body, e.amount, e.check_no)
                day = e.date or day
            elif not suppressed:
                if e.date is not None:
                    end()
                    day = e.date
                if e.amount is not None:
                    text = " ".join([*waiting, e.body]).strip()
                    if e.named or hinted or day or section:
                        row(day, text, e.amount)
                    waiting, hinted = [], False
                elif e.kept or section:
                    waiting.append(e.body)
                    hinted = hinted or bool(e.named)
        self.scan.update((section, suppressed, day, hinted, ord_))
        self.waiting.clear()
        if waiting:
            self.waiting.put([(w,) for w in waiting])
        yield pd.DataFrame(out, columns=["statement_id", "ord", "date", "description", "amount", "check_no", "section"])

    def close(self) -> None:
        pass


def parse_stream(lines: DataFrame, year: Column) -> DataFrame:
    """What lines.parse_lines() gives but for the dropping of repeated rows, for lines that arrive in batches of any cut.

    A line without text (null) ends its statement: lines that still wait become a row, and a statement of the same id begins
    anew. What a line says is columns, for each section that it may turn out to be in; the state then picks. Rows that
    repeat are left to assembly.dedupe_transactions over the rows written.
    """
    spark = lines.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    text = F.trim("text")
    heading = F.when(F.col("text").isNull(), "close").otherwise(predicates.section_of(text))
    headed = lines.filter((text != "") | F.col("text").isNull()).select("statement_id", "line_no", F.coalesce(text, F.lit("")).alias("text"), heading.alias("heading"))
    variants = F.array(*[F.struct(F.lit(i).alias("variant"), F.lit(s).cast("string").alias("section")) for i, s in enumerate(VARIANTS)])
    each = headed.select("*", F.inline(variants))
    events = batch.classified(each, year, "heading", "variant").drop("section")
    rows = events.groupBy("statement_id").transformWithStateInPandas(Gathering(), _ROW, "Append", "None")
    return batch.finish(rows, "text", year)
