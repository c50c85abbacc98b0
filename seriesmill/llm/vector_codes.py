"""Vector code compression: product codes from Hilbert-sorted flat blocks and exact integer kernels.

Components become integers, vectors are cut into PARTS equal parts, and each part position has a codebook of ENTRIES entries
that ROUNDS rounds of assigning and averaging improve. A task lays its vectors out once: some thousand vectors at a time, each
part position's parts are sorted along a Hilbert curve and cut into flat blocks of BLOCK parts, which keep the smallest and
largest value of each component (their box) and the sums of the components. These layouts are a written table. In each round,
every block compares the distances from the entries to its box: an entry whose nearest point of the box is farther than the
farthest point of the box from another entry is nobody's nearest. What is left is the block's shortlist. A shortlist of one entry takes the block
by its sums without looking at the parts; the others compare each part with the entries of their shortlist only.

All distances and sums are exact integers: 64-bit where no square can overflow, Python's own numbers beyond that. The sums of
a round are cut into limbs of LIMB bits, which Spark adds up (PARTS * ENTRIES groups whatever the table) and the driver turns
into the next codebook. No vector is shuffled; only the codes are, once, to add up errors per label.

Rows whose vector is NULL or holds NULL, NaN or infinite components are left out. Vectors of different lengths are tables of
their own with codebooks of their own; a length that PARTS does not divide is filled with zeros at the end, and an empty vector has empty
parts. The first codebook comes from the ENTRIES rows of smallest ids, NULL ids last, rows of one id ordered by their vectors;
of fewer rows, it has fewer entries. Equal vectors give equal codes; repeated rows stay. An error beyond 64 bits is NULL, and so is the
label's sum then. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import saved, table
from .vectors import by_length

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
BLOCK = 32  # parts of a flat block
LAYOUT = 1 << 24  # bytes of 64-bit components laid out together
LIMB = 28
ROWS_A_SALT = 1_000_000
FIELDS = "size int, wide boolean, n int, data binary, place binary, low binary, high binary, sums binary"


def whole(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of doubles, as 64-bit numbers or, where these are too small, Python's."""
    near = np.abs(vectors) < 2.0**40
    if near.all():
        return np.floor(vectors * SCALE).astype(np.int64)
    return np.array([[math.floor(x * SCALE) if abs(x) < 2.0**40 else int(x) * SCALE for x in row] for row in vectors.tolist()], dtype=object)


def safe(width: int) -> int:
    """Components below this in size have differences whose squares add up to less than 2**62 over a part of *width*."""
    return math.isqrt((1 << 60) // max(width, 1))


def hilbert_rank(points: np.ndarray) -> np.ndarray:
    """The order of *points* along a Hilbert curve through their box, by the (at most 16) components that vary most."""
    n, d = points.shape
    if not d or n < 2:
        return np.arange(n)
    low, high = points.min(axis=0), points.max(axis=0)
    axes = np.argsort(-(high - low), kind="stable")[:16]
    bits = min(16, 63 // len(axes))
    span = np.maximum(high - low, 1)[axes]
    shifts = [max(0, int(s).bit_length() - 40) for s in span]
    cells = [(((points[:, a] - low[a]) >> h).astype(np.int64) << bits) // ((int(s) >> h) + 1) for a, s, h in zip(axes, span, shifts)]
    # Undo the turns of the curve from the largest cube to the smallest, then the Gray code.
    for level in range(bits - 1, 0, -1):
        below = (1 << level) - 1
        for cell in cells:
            far = (cell >> level & 1).astype(bool)
            swap = np.where(far, 0, (cells[0] ^ cell) & below)
            cells[0] ^= np.where(far, below, swap)
            cell ^= swap
    for one, other in zip(cells[1:], cells):
        one ^= other
    turn = np.zeros(n, dtype=np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(cells[-1] >> level & 1, (1 << level) - 1, 0)
    key = np.zeros(n, dtype=np.int64)
    for level in range(bits - 1, -1, -1):
        for cell in cells:
            key = key << 1 | (cell ^ turn) >> level & 1
    return np.argsort(key, kind="stable")


def _packed(values: np.ndarray) -> bytes:
    """Numbers as the shortest fixed-width integers; wide ones as texts."""
    if values.dtype == object:
        return ",".join(map(str, values.ravel().tolist())).encode()
    reach = max(-int(values.min(initial=0)), int(values.max(initial=0)))
    width = 2 if reach < 1 << 15 else 4 if reach < 1 << 31 else 8
    return bytes([width]) + values.astype(f"<i{width}").tobytes()


def _unpacked(raw: bytes, wide: bool, shape) -> np.ndarray:
    if wide:
        return np.array([int(x) for x in raw.split(b",") if x], dtype=object).reshape(shape)
    return np.frombuffer(raw, dtype=f"<i{raw[0]}", offset=1).astype(np.int64).reshape(shape)


def _widths(size: int) -> int:
    return -(-size // PARTS)


def _laid_out(rows: np.ndarray, block: int = BLOCK) -> dict:
    """The layout of equally long whole vectors: per part position sorted parts, their rows, boxes and sums of blocks."""
    n, size = rows.shape
    width = _widths(size)
    if width * PARTS > size:
        rows = np.concatenate([rows, np.zeros((n, width * PARTS - size), dtype=rows.dtype)], axis=1)
    parts = rows.reshape(n, PARTS, width).transpose(1, 0, 2)
    order = np.stack([hilbert_rank(part) for part in parts])
    data = np.take_along_axis(parts, order[:, :, None], axis=1)
    begins = np.arange(0, n, block)
    low, high, sums = (f.reduceat(data, begins, axis=1) if width else data[:, begins] for f in (np.minimum, np.maximum, np.add))
    wide = rows.dtype == object
    packed = {"size": size, "wide": wide, "n": n, "data": _packed(data), "place": order.astype("<u4").tobytes()}
    return packed | {"low": _packed(low), "high": _packed(high), "sums": _packed(sums)}


def layouts(df: DataFrame, id: str, vector: str, label: str | None) -> DataFrame:
    """The vectors of *df* as a written table of layouts, with a list of (id, label) each."""
    names = [name for name, *_ in (x.split() for x in FIELDS.split(", "))]
    key = F.struct(df[id].alias("id"), (df[label] if label else F.lit(None).cast("int")).alias("label")).alias("key")
    rows = df.select(key, F.transform(df[vector], lambda x: x.cast("double")).alias("vector")).filter(_taken("vector"))

    def run(batches):
        for batch in batches:
            vectors, keys = batch.column("vector"), batch.column("key")
            for size, at in by_length(vectors.value_lengths().to_numpy()):
                limit, step = safe(_widths(size)), max(BLOCK, LAYOUT // (8 * max(size, 1)))
                for begin in range(0, len(at), step):
                    some = at[begin : begin + step]
                    values = vectors.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).reshape(len(some), size)
                    far = (np.abs(values) * SCALE >= limit - 1).any(axis=1) if size else np.zeros(len(some), dtype=bool)
                    for mine in (some[~far], some[far]):
                        if not len(mine):
                            continue
                        numbers = whole(values[np.searchsorted(some, mine)])
                        laid = _laid_out(numbers.astype(object) if far[np.searchsorted(some, mine[0])] else numbers)
                        listed = keys.take(pa.array(mine))
                        lists = pa.ListArray.from_arrays(pa.array([0, len(mine)], pa.int32()), listed)
                        types = [pa.int32(), pa.bool_(), pa.int32(), *[pa.binary()] * 5]
                        yield pa.RecordBatch.from_arrays([*[pa.array([laid[x]], t) for x, t in zip(names, types)], lists], [*names, "keys"])

    keys = T.StructField("keys", T.ArrayType(rows.schema["key"].dataType))
    return saved(rows.mapInArrow(run, T.StructType([*T._parse_datatype_string(FIELDS).fields, keys])))


def _taken(vector: str):
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def first_books(df: DataFrame, id: str, vector: str) -> dict[int, list[np.ndarray]]:
    """Per length of vectors: the codebook of each part position, from the ENTRIES rows of smallest ids."""
    rows = df.select(df[id].alias("id"), F.transform(df[vector], lambda x: x.cast("double")).alias("vector")).filter(_taken("vector"))
    books = {}
    for size in sorted(r[0] for r in rows.select(F.size("vector")).distinct().collect()):
        first = rows.filter(F.size("vector") == size).orderBy(F.col("id").asc_nulls_last(), "vector").limit(ENTRIES).collect()
        numbers = whole(np.array([r.vector for r in first], dtype=float).reshape(len(first), size)).astype(object)
        width = _widths(size)
        numbers = np.concatenate([numbers, np.zeros((len(first), width * PARTS - size), dtype=object)], axis=1)
        books[size] = list(numbers.reshape(len(first), PARTS, width).transpose(1, 0, 2))
    return books


def _kind(book: np.ndarray, wide: bool) -> np.ndarray:
    """A codebook as 64-bit numbers unless it or the vectors are too wide for exact squares."""
    fits = not wide and (np.abs(book) < safe(book.shape[1])).all()
    return book.astype(np.int64) if fits else book


def shortlists(book: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Per block, which entries can be nearest to a part in the block's box; ties stay."""
    near, far = [], []
    for entry in book:
        below, above = low - entry, entry - high
        outside = np.maximum(np.maximum(below, above), 0)
        near.append((outside * outside).sum(axis=1))
        corner = np.maximum(np.abs(below), np.abs(above))
        far.append((corner * corner).sum(axis=1))
    near, far = np.stack(near, axis=1), np.stack(far, axis=1)
    return near <= far.min(axis=1, keepdims=True)


def nearest(book: np.ndarray, data: np.ndarray, lists: np.ndarray, only: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of each part in the blocks *only*, comparing the entries of the block's shortlist.

    *data* are all parts in order; the result has a row per block, whose last places are unused in a block that is not full.
    """
    width = data.shape[1]
    whole_blocks = np.zeros((len(lists) * block, width), dtype=data.dtype)
    whole_blocks[: len(data)] = data
    blocks = whole_blocks.reshape(len(lists), block, width)[only]
    entry = np.zeros((len(only), block), dtype=np.int64)
    least = np.full((len(only), block), -1, dtype=object if book.dtype == object or data.dtype == object else np.int64)
    for number, center in enumerate(book):
        mine = np.flatnonzero(lists[only, number])
        if not len(mine):
            continue
        apart = blocks[mine] - center
        square = np.einsum("ijk,ijk->ij", apart, apart) if apart.dtype != object else (apart * apart).sum(axis=2)
        before = least[mine]
        closer = ((before < 0) | (square < before)).astype(bool)
        least[mine] = np.where(closer, square, before)
        entry[mine] = np.where(closer, number, entry[mine])
    return entry, least


def _layout(row: dict) -> tuple:
    n, size, wide = row["n"], row["size"], row["wide"]
    width, blocks = _widths(size), -(-n // BLOCK)
    data = _unpacked(row["data"], wide, (PARTS, n, width))
    return (data, *(_unpacked(row[x], wide, (PARTS, blocks, width)) for x in ("low", "high", "sums")))


def _parts(row: dict, books: dict):
    """Per part position of a layout: its codebook, parts, box sums, shortlists, and the blocks with more than one choice."""
    data, low, high, sums = _layout(row)
    for part in range(PARTS):
        book = _kind(books[row["size"]][part], row["wide"])
        lists = shortlists(book, low[part], high[part])
        yield part, book, data[part], sums[part], lists, np.flatnonzero(lists.sum(axis=1) > 1)


def _totals(row: dict, books: dict):
    """(part, entry, sums of the components and the number of parts) for a layout."""
    last = row["n"] - (-(-row["n"] // BLOCK) - 1) * BLOCK
    for part, book, data, sums, lists, open_ in _parts(row, books):
        counts = np.full(len(lists), BLOCK)
        counts[-1] = last
        alone = np.ones(len(lists), dtype=bool)
        alone[open_] = False
        chosen = lists.argmax(axis=1)
        entry, _ = nearest(book, data, lists, open_)
        row_of = (open_[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        full = row_of < len(data)
        row_of, entry = row_of[full], entry.ravel()[full]
        for number in range(len(book)):
            mine, taken = alone & (chosen == number), row_of[entry == number]
            count = int(counts[mine].sum()) + len(taken)
            if count:
                added = [int(a) + int(b) for a, b in zip(sums[mine].sum(axis=0).tolist(), data[taken].sum(axis=0).tolist())]
                yield part, number, [*added, count]


def limbs(value: int) -> list[int]:
    """A whole number as limbs of LIMB bits from the lowest; the last one has the sign."""
    out = []
    while not -(1 << LIMB) < value < 1 << LIMB:
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


def next_books(table: DataFrame, books: dict) -> dict:
    """One round: all parts to their nearest entries, entries to the floor of their parts' means."""
    sent = table.sparkSession.sparkContext.broadcast(books)  # ENTRIES vectors for each length

    def run(batches):
        held: dict[tuple, int] = {}
        for batch in batches:
            for row in batch.to_pylist():
                for part, number, values in _totals(row, sent.value):
                    for place, value in enumerate(values):
                        for limb, digit in enumerate(limbs(value)):
                            key = (row["size"], part, number, place, limb)
                            held[key] = held.get(key, 0) + digit
        columns = list(zip(*[(*key, value) for key, value in held.items()])) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["size", "part", "number", "place", "limb", "value"])

    schema = "size long, part long, number long, place long, limb long, value long"
    found = table.drop("keys", "place").mapInArrow(run, schema)
    rows = found.groupBy("size", "part", "number", "place", "limb").agg(F.sum("value").alias("value")).collect()
    totals: dict[tuple, int] = {}
    for r in rows:
        key = r.size, r.part, r.number, r.place
        totals[key] = totals.get(key, 0) + (r.value << LIMB * r.limb)
    out = {}
    for size, parts in books.items():
        width = _widths(size)
        out[size] = [book.copy() for book in parts]
        for part, number in ((p, n) for p in range(PARTS) for n in range(len(parts[p]))):
            count = totals.get((size, part, number, width), 0)
            if count:
                out[size][part][number] = [totals.get((size, part, number, place), 0) // count for place in range(width)]
    return out


def fitted(table: DataFrame, books: dict, rounds: int = ROUNDS) -> dict:
    """The codebooks after all rounds over a table of layouts."""
    for _ in range(rounds):
        books = next_books(table, books)
    return books


def coded(table: DataFrame, books: dict) -> DataFrame:
    """Rows (id, label, size, code, error): a byte per part position, and the squared distances to the entries, added up."""
    sent = table.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = {x: batch.column(x)[at].as_py() for x in batch.schema.names if x != "keys"}
                place = np.frombuffer(row["place"], dtype="<u4").reshape(PARTS, row["n"])
                codes = np.empty((row["n"], PARTS), dtype=np.uint8)
                error = np.zeros(row["n"], dtype=object)
                for part, book, data, _, lists, _ in _parts(row, sent.value):
                    entry, square = nearest(book, data, lists, np.arange(len(lists)))
                    codes[place[part], part] = entry.ravel()[: row["n"]]
                    error[place[part]] += square.ravel()[: row["n"]]
                keys = batch.column("keys")[at].values
                code = pa.array([x.tobytes() for x in codes], pa.binary())
                errors = pa.array([int(x) if x < 1 << 63 else None for x in error.tolist()], pa.int64())
                columns = [keys.field(0), keys.field(1), pa.array(np.full(row["n"], row["size"], dtype=np.int32)), code, errors]
                yield pa.RecordBatch.from_arrays(columns, ["id", "label", "size", "code", "error"])

    key = table.schema["keys"].dataType.elementType
    fields = [key["id"], key["label"], T.StructField("size", T.IntegerType()), T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())]
    return table.mapInArrow(run, T.StructType(fields))


def decoded(codes: DataFrame, books: dict) -> DataFrame:
    """*codes* with `vector`, the entries of its code put together: whole numbers divided by SCALE."""
    sent = codes.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        for batch in batches:
            sizes, raw = batch.column("size").to_pylist(), batch.column("code").to_pylist()
            vectors = [
                [float(x) / SCALE for part, one in zip(sent.value[size], code) for x in part[one]][:size] for size, code in zip(sizes, raw)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float64()))], [*batch.schema.names, "vector"])

    return codes.mapInArrow(run, T.StructType([*codes.schema.fields, T.StructField("vector", T.ArrayType(T.DoubleType()))]))


def label_errors(codes: DataFrame, salts: int) -> DataFrame:
    """*codes* with `label_error`, the errors of its label added up (NULL labels together).

    Rows of a label are dealt to *salts* groups by their id, and each group is joined with its own row, so that a label that
    many rows share is many keys.
    """
    keys = [F.col("label").isNull().alias("none"), F.col("label").alias("same"), F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt")]
    codes = codes.select("*", *keys)
    groups = codes.groupBy("none", "same", "salt").agg(F.try_sum("error").alias("part"), F.count("*").alias("n"), F.count("error").alias("known"))
    total = groups.groupBy("none", "same").agg(F.try_sum("part").alias("label_error"), F.bool_and((F.col("n") == F.col("known")) & F.col("part").isNotNull()).alias("good"))
    total = total.select("none", "same", F.when(F.col("good"), F.col("label_error")).alias("label_error"))
    dealt = groups.alias("g").join(total.alias("t"), F.col("g.same").eqNullSafe(F.col("t.same"))).select("g.none", "g.same", "g.salt", "t.label_error")
    found = codes.alias("c").join(dealt.alias("d"), F.col("c.same").eqNullSafe(F.col("d.same")) & (F.col("c.salt") == F.col("d.salt")))
    return found.select("c.id", "c.label", "c.size", "c.code", "c.error", "d.label_error")


def books_text(parts: list[np.ndarray]) -> str:
    """All components of a length's codebooks by part, entry and place, as decimal numbers with commas."""
    return ",".join(str(x) for book in parts for entry in book for x in entry)


def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    laid = layouts(vectors, "vec_id", "embedding", "label")
    books = fitted(laid, first_books(vectors, "vec_id", "embedding"))
    rows = laid.agg(F.sum("n")).first()[0] or 0
    salts = max(64, 1 << (rows // ROWS_A_SALT).bit_length())
    found = label_errors(saved(coded(laid, books)), salts)
    prints = {size: hashlib.sha256(books_text(parts).encode()).hexdigest() for size, parts in books.items()}
    digest = functools.reduce(lambda c, x: c.when(F.col("size") == x[0], F.lit(x[1])), prints.items(), F.when(F.lit(False), F.lit("")))
    return found.select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", digest.alias("codebooks_sha256"))


def _sql() -> str:
    """The rounds one after the other, each a table of (part, entry, place, component)."""
    steps = [
        f"""kept AS MATERIALIZED (
  SELECT vec_id, label, embedding AS v, len(embedding) // {PARTS} AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
        f"""parts AS MATERIALIZED (
  SELECT vec_id, i // w AS part, i % w AS place, CAST(floor({SCALE} * CAST(v[i + 1] AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT *, unnest(range(0, len(v))) AS i FROM kept)
)""",
        f"""book0 AS MATERIALIZED (
  SELECT part, entry, place, x FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {ENTRIES}) USING (vec_id)
)""",
    ]
    for k in range(ROUNDS + 1):
        steps.append(
            f"""near{k} AS MATERIALIZED (
  SELECT vec_id, part, min(struct_pack(d := d, entry := entry)) AS best FROM (
    SELECT vec_id, p.part, entry, CAST(sum((p.x - b.x) * (p.x - b.x)) AS BIGINT) AS d
    FROM parts p JOIN book{k} b ON p.part = b.part AND p.place = b.place GROUP BY ALL
  ) GROUP BY ALL
)"""
        )
        if k < ROUNDS:
            steps.append(
                f"""book{k + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, b.place, coalesce(CAST((s - ((s % n) + n) % n) // n AS BIGINT), b.x) AS x FROM book{k} b LEFT JOIN (
    SELECT part, best.entry AS entry, place, sum(x) AS s, count(*) AS n FROM parts JOIN near{k} USING (vec_id, part) GROUP BY ALL
  ) USING (part, entry, place)
)"""
            )
    last = ROUNDS
    steps.append(
        f"""coded AS MATERIALIZED (
  SELECT vec_id, any_value(label) AS label, string_agg(format('{{:02x}}', best.entry), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error
  FROM near{last} JOIN kept USING (vec_id) GROUP BY vec_id
)"""
    )
    digest = f"(SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, place)) FROM book{last})"
    return "WITH " + ",\n".join(steps) + f"\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, {digest} AS codebooks_sha256 FROM coded"


QUERIES = {"op11_vector_codes": (op11_vector_codes, _sql())}
