"""Fill-in-the-middle forms, cut on run-length encoded character classes.

A text is told as its maximal runs of one character class: letters, which are one unit a run, and the
rest by the bytes a character takes in UTF-8, each character a unit. A run is stored by its first byte,
its first character and the units before it, so a cut at a unit is a binary search for the run that
holds it and an offset within: units past the run's start times the class's width. Tokens are never
built. Runs are found in slices of ``SLICE`` bytes, so a long text needs memory for its runs and itself.

Defined cases: null and empty texts are plain and empty; a null id draws as the empty string would;
texts that hold a sentinel stay plain; repeated rows come out as often as they stand and alike; an
empty table gives an empty one; columns beside the id and the text are left out, whatever their names.
Texts of any length are cut whole.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaframe.llm.common import map_rows, read

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SLICE = 1 << 20
LETTER, INSIDE = 0, 255


def _classes() -> np.ndarray:
    """Class by byte: letters 0, other characters by their width in bytes, bytes inside a character 255."""
    out = np.ones(256, np.uint8)
    for a, b, kind in ((0x41, 0x5B, LETTER), (0x61, 0x7B, LETTER), (0x80, 0xC0, INSIDE), (0xC0, 0xE0, 2), (0xE0, 0xF0, 3), (0xF0, 0xF8, 4)):
        out[a:b] = kind
    return out


CLASS = _classes()


class Runs(NamedTuple):
    """Per run: first byte, first character, units before it, class; and the text's bytes, characters and units."""

    byte: np.ndarray
    char: np.ndarray
    unit: np.ndarray
    kind: np.ndarray
    total: tuple[int, int, int]


def class_runs(raw: bytes) -> Runs:
    """The runs of a text in UTF-8."""
    buf, found, last, chars = np.frombuffer(raw, np.uint8), [], None, 0
    for base in range(0, len(buf), SLICE):
        kind = CLASS[buf[base : base + SLICE]]
        at = None
        if kind.max() == INSIDE:
            at = np.flatnonzero(kind != INSIDE)
            kind = kind[at]
        if len(kind):
            new = np.flatnonzero(kind[1:] != kind[:-1]) + 1
            if kind[0] != last:
                new = np.concatenate([[0], new])
            found.append((base + (new if at is None else at[new]), chars + new, kind[new]))
            last, chars = kind[-1], chars + len(kind)
    if not found:
        none = np.zeros(0, np.int64)
        return Runs(none, none, none, none, (len(buf), 0, 0))
    byte, char, kind = (np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True))
    units = np.where(kind == LETTER, 1, np.diff(char, append=chars))
    ends = np.cumsum(units)
    return Runs(byte, char, ends - units, kind, (len(buf), chars, int(ends[-1])))


def place(runs: Runs, unit: int) -> tuple[int, int]:
    """The byte and the character at which a unit begins; the text's end for the unit after the last."""
    if unit >= runs.total[2]:
        return runs.total[:2]
    i = int(np.searchsorted(runs.unit, unit, side="right")) - 1
    past = unit - int(runs.unit[i])  # 0 in a run of letters
    return int(runs.byte[i]) + past * int(runs.kind[i]), int(runs.char[i]) + past


def draws(doc_id, seed: int = 1) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits from the seed and the id alone."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def infill(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1, share: int = 90, suffix_first: int = 20) -> DataFrame:
    """key, n, form, prefix_chars, middle_chars, output: each text cut at two units drawn from its id.

    share: texts of a hundred that are cut at all; suffix_first: cut texts of a hundred that put the
    suffix first (``spm``), the others are ``psm``. ``plain`` texts come out as they are.
    """
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))

    def go(ids: list, texts) -> tuple:
        import pyarrow as pa

        out: tuple[list, ...] = ([], [], [], [], [])
        for doc_id, raw in zip(ids, texts.cast(pa.large_binary()).to_pylist(), strict=True):
            raw = raw or b""
            runs, (h1, h2, h3, h4) = class_runs(raw), draws(doc_id, seed)
            n = runs.total[2]
            row = (n, "plain", None, None, raw)
            if raw and h3 % 100 < share and p not in raw and s not in raw and m not in raw:
                a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
                (i, c), (j, d) = place(runs, a), place(runs, b)
                form = "spm" if h4 % 100 < suffix_first else "psm"
                row = (n, form, c, d - c, b"".join((s, raw[j:], p, raw[:i], m, raw[i:j]) if form == "spm" else (p, raw[:i], s, raw[j:], m, raw[i:j])))
            for column, value in zip(out, row, strict=True):
                column.append(value)
        whole = pa.array(out[4], pa.large_binary())
        return *out[:4], pa.Array.from_buffers(pa.large_string(), len(whole), whole.buffers())

    return map_rows(docs.select(F.col(key), F.col(text)), [key], [key, text], go, "n long, form string, prefix_chars long, middle_chars long, output string", raw=[text])


def restored(output: Column, form: Column) -> Column:
    """The text that infill() cut, from its output and form alone: a cut text holds no sentinel."""
    first, second = F.when(form == "spm", SUFFIX).otherwise(PREFIX), F.when(form == "spm", PREFIX).otherwise(SUFFIX)
    body = F.substring(output, F.length(first) + 1, F.length(output))
    middle = F.substring_index(body, MIDDLE, -1)
    head = F.substring_index(body, MIDDLE, 1)
    left = F.when(form == "spm", F.substring_index(head, PREFIX, 1)).otherwise(F.substring_index(head, SUFFIX, 1))
    right = F.substring(head, F.length(left) + F.length(second) + 1, F.length(head))
    return F.when(form == "plain", output).when(form == "spm", F.concat(right, middle, left)).otherwise(F.concat(left, middle, right))


def op11_infill_run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = infill(read(spark, sf_dir, "documents", ["doc_id", "text"]))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS s, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS t,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), u AS (
  SELECT doc_id, s, t, CAST(len(t) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(t) + 1) AS x, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(t) + 1) AS y,
    CASE WHEN s = '' OR contains(s, '<P>') OR contains(s, '<S>') OR contains(s, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
      WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), c AS (
  SELECT doc_id, s, n, form, array_to_string(t[1:least(x, y)], '') AS p, array_to_string(t[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(t[greatest(x, y) + 1:n], '') AS z
  FROM u
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN s WHEN 'psm' THEN '<P>' || p || '<S>' || z || '<M>' || m ELSE '<S>' || z || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(s) AS restored_sha256
FROM c
"""

QUERIES = {"op11_infill_run_lengths": op11_infill_run_lengths}
ORACLES = {"op11_infill_run_lengths": SQL}
