"""Product quantisation codes by Lloyd's rounds with Elkan's bounds.

Vectors become integers, floor(scale * x), and fall into equal consecutive parts; each part position has
a codebook of its own. Between rounds a written table holds, for every part of every vector, its entry,
one upper bound on the distance to it and one lower bound on the distance to every entry. When entries
move, the upper bound grows by the movement of the part's own entry and each lower bound shrinks by that of
its entry. An entry is ruled out only where the triangle inequality puts it strictly farther away
than the part's own entry; the others are compared by squared distances in integers, ties to the lower
index, so the codes are those of the plain rounds whatever the bounds are. Bounds only ever err to
the safe side: upper ones are rounded up, lower ones are stored in a byte each, rounded down, in
units of the part's largest.

New entries are floor(sum / count) of integer sums, which tasks add up for their rows and Spark adds up by
part and entry; what reaches the driver is one row an entry. Sums are kept in limbs of 24 bits, so they
are exact whatever the components are; distances are exact in doubles up to 2^53, in 64-bit integers up to
2^62, beyond in integers of any size. Errors beyond a long saturate at 2^63 - 1.

Defined cases: vectors that are null or hold null, NaN or infinite components, or one whose scaled value no
double holds, are dropped; the smallest kept vec_id (null ids come last; equal ids by their components)
sets the length, and vectors of another length, or of one that the parts do not divide, have a null code
and error; fewer kept vectors than entries make a smaller codebook, repeated vectors repeated
entries (the lower index wins); an empty table gives an empty one; columns beside key, vector and label are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaframe.llm.common import configure, materialize, read, release

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
LIMB = 24
STATE = "vec_id {key}, label {label}, v {vector}, own binary, upper binary, lower binary, unit binary, error long"
DOUBLE, LONG = 2.0**53, 2.0**62
MOST = np.iinfo(np.int64).max
PAIRS = 1 << 16


def integers(df: DataFrame, key: str, vector: str, label: str, scale: int) -> DataFrame:
    """vec_id, label, v: kept vectors with components floor(scale * x) as doubles, which hold them exactly."""
    v = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    # floor() of a double is a long in Spark and saturates: larger values are whole numbers already.
    whole = F.transform(F.col(vector), lambda x: x.cast("double") * scale)
    v = F.zip_with(v, whole, lambda a, b: F.when(F.abs(b) < 2.0**52, a).otherwise(b))
    rows = df.select(F.col(key).alias("vec_id"), F.col(label).alias("label"), v.alias("v"))
    bad = F.exists("v", lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
    return rows.where(F.col("v").isNotNull() & ~bad)


def _exact(x: np.ndarray, y: np.ndarray):
    """x and y in a type in which squared distances between them are exact."""
    most = max(np.abs(x).max(initial=0), np.abs(y).max(initial=0))
    square = 4.0 * x.shape[-1] * float(most) ** 2
    if square < DOUBLE:
        return x, y
    if square < LONG:
        return x.astype(np.int64), y.astype(np.int64)
    return _whole(x), _whole(y)


def _whole(x: np.ndarray) -> np.ndarray:
    """As integers of any size."""
    return np.frompyfunc(int, 1, 1)(x) if x.size else x.astype(object)


def _up(x):
    """A double not below the square root of an exact value."""
    return np.nextafter(np.sqrt(np.asarray(x, np.float64)) * (1 + 1e-12), np.inf)


def _down(x):
    return np.maximum(np.sqrt(np.asarray(x, np.float64)) * (1 - 1e-12) - 1e-300, 0.0)


def _dense(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all entries."""
    if x.dtype == np.float64:
        return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)
    return np.stack([((x - e) ** 2).sum(1) for e in c], axis=1)


def assign(x: np.ndarray, c: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, apart: np.ndarray, exact: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """The nearest entry of every row, its squared distance, new bounds, and how many pairs were compared.

    own, upper, lower: entries and bounds so far, the bounds valid for the entries c. apart: lower bounds
    on half the distances between entries. Rows whose bounds rule out all other entries are not
    looked at; their distance is 0 here unless all are asked for by exact.
    """
    n, k = len(x), len(c)
    x, c = _exact(x, c)
    own, upper, lower = own.copy(), upper.copy(), lower.copy()

    def left(rows: np.ndarray) -> np.ndarray:
        """Entries that neither bound puts strictly farther away than the row's own."""
        out = (lower[rows] <= upper[rows][:, None]) & (apart[own[rows]] <= upper[rows][:, None])
        out[np.arange(len(rows)), own[rows]] = False
        return out

    every = np.arange(n)
    rows = every if exact else every[left(every).any(1)]
    best = np.zeros(n, x.dtype)
    best[rows] = ((x[rows] - c[own[rows]]) ** 2).sum(1)
    upper[rows] = np.minimum(upper[rows], _up(best[rows]))
    lower[rows, own[rows]] = _down(best[rows])
    open_ = left(rows)
    compared, many = int(open_.sum()), open_.sum(1) * 4 > k
    full = rows[many]
    if len(full):  # a quarter of all entries is open: all are compared
        d = _dense(x[full], c)
        own[full] = d.argmin(1)  # the first of equal ones
        best[full], lower[full] = d[np.arange(len(full)), own[full]], _down(d)
    open_[many] = False
    r, e = np.nonzero(open_)
    if len(r):
        r = rows[r]
        d = np.concatenate([((x[r[a : a + PAIRS]] - c[e[a : a + PAIRS]]) ** 2).sum(1) for a in range(0, len(r), PAIRS)])
        lower[r, e] = _down(d)
        order = np.array(sorted(range(len(r)), key=lambda i: (r[i], d[i], e[i]))) if d.dtype == object else np.lexsort((e, d, r))
        first = order[np.flatnonzero(np.r_[True, r[order][1:] != r[order][:-1]])]
        row, entry, found = r[first], e[first], d[first]
        nearer = (found < best[row]) | ((found == best[row]) & (entry < own[row]))
        own[row[nearer]], best[row[nearer]] = entry[nearer], found[nearer]
    upper[rows] = _up(best[rows])
    return own, best, upper, lower, compared


def _pack(lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower bounds as bytes, rounded down, and the unit of each row."""
    unit = np.maximum(lower.max(1), 1e-300) / 255 * (1 + 1e-6)
    unit = unit.astype(np.float64)
    return np.floor(lower / unit[:, None] * (1 - 1e-9)).clip(0, 255).astype(np.uint8), unit


def _vectors(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _binary(rows: np.ndarray):
    """A binary Arrow value per row of an array."""
    import pyarrow as pa

    raw, size = np.ascontiguousarray(rows), rows[0].nbytes if len(rows) else 0
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(rows), [None, pa.py_buffer(raw)]).cast(pa.binary()) if size else pa.array([b""] * len(rows), pa.binary())


def _floats(column, shape: tuple, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(shape)


def _round(table: DataFrame, books: np.ndarray, moved: np.ndarray | None, last: bool) -> DataFrame:
    """The state after all parts are assigned to entries. moved: how far each entry came since the bounds in the table were made; without it there are none. last: errors are made."""
    import pyarrow as pa

    kinds = dict(table.dtypes)
    schema = STATE.format(key=kinds["vec_id"], label=kinds["label"], vector=kinds["v"])
    parts, k, width = books.shape
    half = []
    for c in books:
        a, b = _exact(c, c)
        half.append(_down(np.asarray(_dense(a, b), np.float64)) / 2 * (1 - 1e-9))
    half = np.array(half)

    def go(batches: Iterator) -> Iterator:
        names = ["vec_id", "label", "v", "own", "upper", "lower", "unit", "error"]
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            v = _vectors(batch.column(2)).reshape(n, parts, width)
            if moved is None:
                own, upper, lower = np.zeros((n, parts), np.int64), np.full((n, parts), np.inf), np.zeros((n, parts, k))
            else:
                own = _floats(batch.column(3), (n, parts), "<u2").astype(np.int64)
                upper = _floats(batch.column(4), (n, parts), "<f8") + np.take_along_axis(moved[None], own[:, :, None], 2)[:, :, 0]
                unit = _floats(batch.column(6), (n, parts), "<f8")
                lower = np.maximum(_floats(batch.column(5), (n, parts, k), np.uint8) * unit[:, :, None] - moved, 0.0)
            error = np.zeros(n, object)
            up, low, units = np.empty((n, parts)), np.empty((n, parts, k), np.uint8), np.empty((n, parts))
            for p in range(parts):
                own[:, p], best, up[:, p], bounds, _ = assign(v[:, p], books[p], own[:, p], upper[:, p], lower[:, p], half[p], last)
                low[:, p], units[:, p] = _pack(bounds)
                error = error + best.astype(object)
            error = pa.array([min(int(e), MOST) for e in error], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), _binary(own.astype("<u2")), _binary(up), _binary(low.reshape(n, -1)), _binary(units), error], names=names)

    return table.mapInArrow(go, schema)


def _sums(table: DataFrame, shape: tuple[int, int, int], limbs: int) -> np.ndarray:
    """Per part and entry the number of its parts and the sums of their components, as integers of any size."""
    import pyarrow as pa

    parts, k, width = shape

    def go(batches: Iterator) -> Iterator:
        total, count = np.zeros((parts, k, width, limbs), np.int64), np.zeros((parts, k), np.int64)
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            v = _vectors(batch.column(0)).reshape(n, parts, width)
            own = _floats(batch.column(1), (n, parts), "<u2").astype(np.int64)
            left = v.copy()
            for limb in range(limbs):
                top = limb == limbs - 1
                digit = left if top else left - np.floor(left / 2.0**LIMB) * 2.0**LIMB
                left = np.floor(left / 2.0**LIMB)
                digit = digit.astype(np.int64)
                for p in range(parts):
                    np.add.at(total[p, :, :, limb], own[:, p], digit[:, p])
            for p in range(parts):
                count[p] += np.bincount(own[:, p], minlength=k)
        at = np.argwhere(count)
        if len(at):
            p, e = at.T
            flat = total[p, e].reshape(len(at), -1)
            ends = pa.array(np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p, e]), pa.ListArray.from_arrays(ends, pa.array(flat.ravel()))], names=["part", "entry", "n", "s"])

    local = table.select("v", "own").mapInArrow(go, "part int, entry int, n long, s array<long>")
    summed = local.select("part", "entry", "n", F.posexplode("s").alias("i", "x")).groupBy("part", "entry", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    rows = summed.groupBy("part", "entry").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda t: t["x"]).alias("s")).collect()  # one row an entry
    out = np.zeros((parts, k), object)
    for r in rows:
        whole = np.array(r.s, object).reshape(width, limbs)
        out[r.part, r.entry] = (r.n, [sum(int(x) << (LIMB * i) for i, x in enumerate(w)) for w in whole])
    return out


def encode(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code, error of every kept vector, and the codebooks as integers by part, entry and place.

    entries: at most 65,536; a code has as many hex digits an entry as the largest index needs, two at least.
    """
    configure(df.sparkSession)
    kept = materialize(integers(df, key, vector, label, scale), "vectors")
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("vec_id", "v").collect()  # the codebooks' first entries
    size = len(first[0].v) if first else 0
    if not size or size % parts:
        return kept.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")), np.zeros((parts, 0, 0), object)
    fits = F.size("v") == size
    if any(len(r.v) != size for r in first):
        first = kept.where(fits).orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
    books = np.array([r.v for r in first]).reshape(len(first), parts, size // parts).transpose(1, 0, 2)
    most = kept.where(fits).agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0]
    limbs = max(1, -(-(int(most).bit_length() + 1) // LIMB))

    table, moved = kept.where(fits), None
    for turn in range(rounds + 1):
        before, table = table, materialize(_round(table, books, moved, turn == rounds), f"bounds-{turn}")
        if turn:
            release(before)
        if turn == rounds:
            break
        sums, new = _sums(table, books.shape, limbs), books.astype(object)
        for p, e in np.argwhere(sums):
            n, s = sums[p, e]
            new[p, e] = [x // n for x in s]
        old, books = books, new.astype(np.float64) if np.abs(new).max() < DOUBLE else new
        a, b = _exact(old.reshape(-1, books.shape[2]), books.reshape(-1, books.shape[2]))
        moved = _up(((a - b) ** 2).sum(1)).reshape(books.shape[:2])
    digits = max(2, len(f"{len(first) - 1:x}"))

    # The bytes of the indexes in the order of a hex text's digits.
    hexed = F.hex("own")
    one = lambda p: F.lower(F.substring(F.concat(F.substring(hexed, 4 * p + 3, 2), F.substring(hexed, 4 * p + 1, 2)), 5 - digits, digits))
    done = table.select("vec_id", "label", F.concat(*(one(p) for p in range(parts))).alias("code"), "error")
    rest = kept.where(~fits).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return done.unionByName(rest), _whole(books)


def _books_sql() -> str:
    """Rounds unrolled as common table expressions; vec_id is a key in the given tables."""
    near = """a{n} AS MATERIALIZED (
  SELECT vec_id, label, part, any_value(x) AS x, min({{'d': d, 'i': i}}) AS m FROM (
    SELECT vec_id, label, part, x, i, list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS d FROM p JOIN c{n} USING (part))
  GROUP BY vec_id, label, part)"""
    move = """c{m} AS MATERIALIZED (
  SELECT o.part, o.i, coalesce(n.c, o.c) AS c FROM c{n} o LEFT JOIN (
    SELECT part, i, list(y ORDER BY j) AS c FROM (
      SELECT part, m.i AS i, j, floor(sum(x[j]) / count(*)) AS y FROM a{n}, (SELECT unnest(range(1, 17)) AS j) GROUP BY ALL) GROUP BY part, i) n ON n.part = o.part AND n.i = o.i)"""
    steps = [s.format(n=t, m=t + 1) for t in range(ROUNDS) for s in (near, move)] + [near.format(n=ROUNDS)]
    return (
        """WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (SELECT vec_id, label, part, e[16 * part + 1:16 * part + 16] AS x FROM v, (SELECT unnest(range(4)) AS part)),
c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS i, x AS c FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 256)),
"""
        + ",\n".join(steps)
        + f""",
r AS (SELECT vec_id, label, string_agg(printf('%02x', m.i), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(CAST(y AS BIGINT) AS VARCHAR), ',' ORDER BY part, i, j)) FROM (SELECT part, i, unnest(c) AS y, unnest(range(16)) AS j FROM c{ROUNDS})) AS codebooks_sha256
FROM r"""
    )


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel())).encode()).hexdigest()


def with_labels(codes: DataFrame, label: str = "label") -> DataFrame:
    """label_error beside each row: its label's errors summed, pre-aggregated and joined back by a null-safe key; null where no row has one."""
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = codes.groupBy(label).agg(F.least(total, F.lit(MOST).cast("decimal(38,0)")).cast("long").alias("label_error")).withColumnRenamed(label, "__label")
    return codes.join(sums, codes[label].eqNullSafe(sums["__label"]), "left").drop("__label")


def op13_elkan_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = encode(read(spark, sf_dir, "embeddings"))
    return with_labels(codes).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


QUERIES = {"op13_elkan_vector_codes": op13_elkan_vector_codes}
ORACLES = {"op13_elkan_vector_codes": _books_sql()}
