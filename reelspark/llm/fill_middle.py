"""Fill-in-middle: texts cut into prefix, middle and suffix between tokens and put into another order.

The tokenizers library's Split pre-tokenizer, with its matches isolated, gives the code-point offsets of the
tokens; nothing is trained. The number of offsets is n, and a text's draws, taken from a hash of its id,
rank two of the n + 1 bounds: the offsets at these ranks slice the text. A text goes to the end of a
document as it is (plain), or as prefix, suffix, middle (psm), or as suffix, prefix, middle (spm).

Defined results: a null or empty text is plain; so is one that holds a mark, as its pieces couldn't be told
apart again; a null id draws as an empty one would; repeated rows draw alike; texts of any length are cut
whole (a text needs the memory of its tokens); an empty table gives no rows; further columns, whatever
their names, don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from reelspark.llm.common import id_and_text

TOKEN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Texts transformed, and suffix-first ones among them, in a hundred.
RATE, SUFFIX_FIRST, SEED = 50, 80, 42
TEXTS = 512


@dataclass(frozen=True)
class Cut:
    """A text's form and, unless it is plain, where its prefix and its middle end."""

    n: int
    form: str
    low: int | None = None
    high: int | None = None


@dataclass(frozen=True)
class FillMiddle:
    """The transformation and its inverse; rates are in a hundred."""

    rate: int = RATE
    suffix_first: int = SUFFIX_FIRST
    seed: int = SEED

    def draws(self, doc_id: int | None) -> list[int]:
        digest = hashlib.sha256(f"{self.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]

    def cut(self, splitter: Split, doc_id: int | None, text: str) -> Cut:
        offsets = [o for _, o in splitter.pre_tokenize_str(text)] if text else []
        n = len(offsets)
        a, b, form, order = self.draws(doc_id)
        if not text or form % 100 >= self.rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
            return Cut(n, "plain")
        ends = [0, *(end for _, end in offsets)]
        low, high = sorted((a % (n + 1), b % (n + 1)))
        return Cut(n, "spm" if order % 100 < self.suffix_first else "psm", ends[low], ends[high])

    @staticmethod
    def output(text: str, cut: Cut) -> str:
        if cut.form == "plain":
            return text
        prefix, middle, suffix = text[: cut.low], text[cut.low : cut.high], text[cut.high :]
        return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}" if cut.form == "psm" else f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"

    @staticmethod
    def restored(output: str, form: str) -> str:
        """The text that an output of this form was made of."""
        if form == "plain":
            return output
        first, rest = output[len(PREFIX) :].split(SUFFIX if form == "psm" else PREFIX, 1)
        second, middle = rest.split(MIDDLE, 1)
        return first + middle + second if form == "psm" else second + middle + first


def _splitter() -> Split:
    return Split(Regex(TOKEN), "isolated")


def fill_middle(docs: DataFrame, rule: FillMiddle = FillMiddle(), digests: bool = False) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every row; with digests the SHA-256 of the
    output and of the text restored from it in place of the output."""
    columns = "output_sha256 string, restored_sha256 string" if digests else "output string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = _splitter()
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        for batch in batches:
            for k in range(0, batch.num_rows, TEXTS):
                part = batch.slice(k, TEXTS)
                rows = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    c = rule.cut(splitter, doc_id, text)
                    made = rule.output(text, c)
                    last = (sha(made), sha(rule.restored(made, c.form))) if digests else (made,)
                    rows.append((c.n, c.form, c.low, None if c.low is None else c.high - c.low, *last))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * (1 + digests)]
                cols = [pa.array(x, t) for x, t in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], ["doc_id", *(f"c{k}" for k in range(len(cols)))])

    return id_and_text(docs).mapInArrow(run, f"doc_id long, n long, form string, prefix_chars long, middle_chars long, {columns}")


def restore(rows: DataFrame) -> DataFrame:
    """doc_id and text of rows with doc_id, form and output; a null output is an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [FillMiddle.restored(o or "", f) if o else "" for f, o in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(rows["doc_id"].cast("long").alias("doc_id"), rows["form"], rows["output"]).mapInArrow(run, "doc_id long, text string")
