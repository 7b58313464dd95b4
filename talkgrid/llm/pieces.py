"""Splitting oversized texts at natural boundaries, with overlap.

A text is read in ranges with a halo on both sides.  A worker finds the boundaries of its own range and
returns one byte for every code point: the kind of boundary after it, and its width.  Nothing is thinned, as
any boundary may be the last one before a limit or the first one of an overlap.  The pieces are laid out on
these bytes, range after range (running sums of the widths give every boundary its place in the whole text
and tell whether the text is too large at all), and then cut by their offsets from the range they begin in,
whose halo reaches as far as a piece may.  The whole text is needed for none of these steps: a text in a table
leaves the scan as ranges, texts in files are read by byte offset only, and a layout holds one block and one
piece at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from talkgrid.operators.durable import cut_lineage

#: Characters of a range of a text in a table, and of its halo.
RANGE_CHARS, HALO_CHARS = 1 << 16, 64
#: The same for files, in bytes.
RANGE_BYTES, HALO_BYTES = 1 << 22, 256
#: Code points of a file that travel in one row.
BLOCK = 1 << 13

# Kinds of boundaries, from the strongest: after a sentence or line, after a clause, after a word, between
# characters that belong together less than others, and between any two code points.
SENTENCE, CLAUSE, WORD, CLUSTER, POINT = 4, 3, 2, 1, 0

_CLOSING = r"[」』】〉》”’\"')）\]｣]*"
_SENTENCE = regex.compile(rf"(?:[。｡！？!?।॥؟…]+{_CLOSING}\s*|\.{_CLOSING}(?:\s*$|\s+(?=[\p{{Lu}}\p{{Lo}}\"“「『¿¡(\[*]))|\s*[\r\n]+\s*|[　 ]*　[　 ]*)")
_CLAUSE = regex.compile(rf"[、､，,;；:：—–]+{_CLOSING}(?!\d)\s*|\.+{_CLOSING}\s+")
_WORD = regex.compile(r"\s+")
_CLUSTER = regex.compile(r"\X")
#: Code points that may belong together with a neighbour.
_JOINING = regex.compile(r"[^\p{GCB=Other}\p{GCB=Control}\p{GCB=LF}]")


def boundaries(text: str, first: int, last: int) -> list[tuple[int, int]]:
    """(place, kind) of the boundaries with first < place <= last, each place once with its strongest kind, in order."""
    kinds: dict[int, int] = {}
    for kind, pattern in ((WORD, _WORD), (CLAUSE, _CLAUSE), (SENTENCE, _SENTENCE)):
        for match in pattern.finditer(text):
            if first < match.end() <= last:
                kinds[match.end()] = kind
    return sorted(kinds.items())


def range_marks(text: str, first: int, last: int, unit: str) -> np.ndarray:
    """One byte for every code point of text[first:last]: the kind of the boundary after it, and eight times its width in `unit`."""
    width = np.ones(last - first, np.uint8)
    if unit == "bytes":
        points = np.frombuffer(text[first:last].encode("utf-32-le", "surrogatepass"), np.uint32)
        width = (width + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)).astype(np.uint8)
        width[(points >= 0xDC80) & (points <= 0xDCFF)] = 1  # a byte of a file that is not UTF-8
    kind = np.full(last - first, CLUSTER, np.uint8)
    if _JOINING.search(text):
        kind[:] = POINT
        ends = np.fromiter((m.end() for m in _CLUSTER.finditer(text)), np.int64)
        kind[ends[(ends > first) & (ends <= last)] - first - 1] = CLUSTER
    for place, k in boundaries(text, first, last):
        kind[place - first - 1] = k
    return kind | width << 3


def _table(marks: np.ndarray, chars: int = 0, size: int = 0) -> np.ndarray:
    """(characters, units, kind) of every boundary, counted on from `chars` and `size`."""
    return np.stack([chars + 1 + np.arange(len(marks)), size + np.cumsum(marks >> 3, dtype=np.int64), marks & 7], axis=1)


def range_table(text: str, first: int, last: int, unit: str, max_size: int | None = None) -> tuple[int, np.ndarray]:
    """Size of text[first:last] in `unit` and all its boundaries (place in characters from `first`, size up to there, kind), whatever the limit."""
    table = _table(range_marks(text, first, last, unit))
    return int(table[-1, 1]) if len(table) else 0, table


#: Where to look for the end of a piece: kinds and the least part of the limit that the piece must fill.
_CHOICES = ((SENTENCE, 0.5), (CLAUSE, 0.5), (SENTENCE, 0.0), (CLAUSE, 0.0), (WORD, 0.0), (CLUSTER, 0.0), (POINT, 0.0))


class Layout:
    """Pieces of one text, whose boundaries come in order and are dropped when no later piece can need them."""

    def __init__(self, max_size: int, overlap: int):
        self.max_size, self.overlap = max_size, min(overlap, max_size - 1)
        self.start_c = self.start = self.done = self.chars = self.size = 0
        self.table = np.zeros((0, 3), np.int64)

    def marks(self, marks: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """The pieces that end before the next of these code points can matter."""
        step = max(1 << 16, self.max_size)
        for i in range(0, len(marks), step):
            table = _table(marks[i : i + step], self.chars, self.size)
            yield from self.feed(table, *table[-1, :2].tolist())

    def feed(self, table: np.ndarray, chars: int, size: int) -> Iterator[tuple[int, int, int, int]]:
        """The pieces that can be told when the text is known up to `chars` and `size`."""
        self.table = np.concatenate([self.table[np.searchsorted(self.table[:, 1], self.start, "right") :], table])
        self.chars, self.size = chars, size
        if size - self.start <= self.max_size:
            return
        by_kind = {kind: self.table[self.table[:, 2] >= kind, :2].T.copy() for kind in (SENTENCE, CLAUSE, WORD, CLUSTER, POINT)}
        while size - self.start > self.max_size:
            end = None
            for kind, fill in _CHOICES:
                units, places = by_kind[kind][1], by_kind[kind][0]
                k = int(np.searchsorted(units, self.start + self.max_size, "right")) - 1
                # A piece must pass what the one before it repeats, or it would bring nothing new.
                if k >= 0 and units[k] > max(self.done, self.start + fill * self.max_size):
                    end, end_c = int(units[k]), int(places[k])
                    break
            if end is None:
                raise ValueError(f"no code point ends within {self.max_size} units of {self.start}")
            yield self.start_c, end_c, self.start, end
            new_start, new_c = end, end_c
            points = by_kind[POINT][1]
            k = int(np.searchsorted(points, end, "right"))
            # The next piece needs room for one more code point than it repeats.
            room = int(points[k]) - self.max_size if k < len(points) else 0
            for kind in (WORD, CLUSTER):
                units, places = by_kind[kind][1], by_kind[kind][0]
                k = int(np.searchsorted(units, max(end - self.overlap, self.start + 1, room)))
                if k < len(units) and units[k] < end:
                    new_start, new_c = int(units[k]), int(places[k])
                    break
            self.start, self.start_c, self.done = new_start, new_c, end

    def rest(self) -> tuple[int, int, int, int]:
        """The last piece, when all has been fed."""
        return self.start_c, self.chars, self.start, self.size


def lay_out(table: Sequence[tuple[int, int, int]], chars: int, size: int, max_size: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """Pieces (from, to in characters; from, to in the unit) of a text of `chars` characters and `size` units.

    `table` holds (characters, units, kind) of the boundaries.  Every piece is within max_size; it begins at
    most `overlap` units before the end of the piece before it, and after that piece's start.
    """
    layout = Layout(max_size, overlap)
    return [*layout.feed(np.asarray(table, np.int64).reshape(-1, 3), chars, size), layout.rest()]


_RANGE = "target string, item_id bigint, version bigint, no int, unit string, max_size bigint, overlap_size bigint, before int, own int, chunk string"
_MARKS = "target string, item_id bigint, version bigint, no int, block int, max_size bigint, overlap_size bigint, marks binary"
_PIECE = "target string, item_id bigint, version bigint, piece_no bigint, from_char bigint, to_char bigint, from_unit bigint, to_unit bigint"
#: Characters of ranges that leave a worker in one batch.
SEND = 1 << 22


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (f.split() for f in ddl.split(", "))])


def size_of(text: Column, unit: Column) -> Column:
    """Size of a text in its unit: code points, or bytes of UTF-8."""
    return F.when(unit == "bytes", F.octet_length(text)).otherwise(F.char_length(text)).cast("bigint")


def _cut_ranges(range_chars: int, halo: int):
    """Texts become ranges with halo, one text at a time; a text of one range within its limit gives none."""
    schema = _schema(_RANGE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            texts = batch.column("text")
            for i, (target, item, version, unit, most, overlap) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("target", "item_id", "version", "unit", "max_size", "overlap_size")))):
                text = texts[i].as_py()
                width = max(range_chars, most)  # a piece reaches into the range after its own at most
                if len(text) <= width and (len(text) if unit == "chars" else len(text.encode("utf-8", "surrogatepass"))) <= most:
                    continue
                for no, begin in enumerate(range(0, len(text), width)):
                    before = min(halo, begin)
                    chunk = text[begin - before : begin + width + max(halo, most)]
                    rows.append((target, item, version, no, unit, most, overlap, before, min(width, len(text) - begin), chunk))
                    held += len(chunk)
                    if held > SEND:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def _range_marks(halo: int):
    """The boundaries of ranges, in blocks of code points."""
    schema = _schema(_MARKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for target, item, version, no, unit, most, overlap, before, own, chunk in zip(*(c.to_pylist() for c in batch.columns)):
                marks = range_marks(chunk[: before + own + halo], before, before + own, unit).tobytes()
                rows += [(target, item, version, no, k, most, overlap, marks[i : i + BLOCK]) for k, i in enumerate(range(0, len(marks), BLOCK))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(schema), schema)], schema=schema)

    return run


def _lay_out_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks come in order, item after item; of each item only the layout's state is held.  Items within their limit give no rows."""
    schema = _schema(_PIECE)
    current, version, layout, n, rows = None, None, None, 0, []

    def closed() -> None:
        if layout is not None and n:
            rows.append((*current, version, n, *layout.rest()))

    for batch in batches:
        for target, item, ver, _, _, most, overlap, marks in zip(*(c.to_pylist() for c in batch.columns)):
            if (target, item) != current:
                closed()
                current, version, layout, n = (target, item), ver, Layout(most, overlap), 0
            if ver != version:
                continue  # another text under the same id: the first one counts
            for piece in layout.marks(np.frombuffer(marks, np.uint8)):
                rows.append((*current, version, n, *piece))
                n += 1
            if len(rows) > 1 << 14:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows.clear()
    closed()
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def item_ranges(items: DataFrame, limits: DataFrame, range_chars: int = RANGE_CHARS, halo: int = HALO_CHARS) -> DataFrame:
    """Ranges with halo of every text that may be above its limit; repeated deliveries count once.

    No text whose bytes are within the limit is above it in any unit, so these never leave the scan.
    """
    known = limits.where("unit IN ('chars', 'bytes')").select("target", "unit", "max_size", F.coalesce("overlap_size", F.lit(0)).alias("overlap_size"))
    read = items.select("target", "item_id", "text", F.xxhash64("text").alias("version")).join(known, "target").where(F.octet_length("text") > F.col("max_size"))
    return read.mapInArrow(_cut_ranges(range_chars, halo), _RANGE).dropDuplicates(["target", "item_id", "version", "no"])


def piece_offsets(ranges: DataFrame, halo: int = HALO_CHARS) -> DataFrame:
    """target, item_id, version, piece_no, from and to (in characters and in units) of every item above its limit, from its ranges."""
    marked = ranges.mapInArrow(_range_marks(halo), _MARKS)
    in_order = marked.repartition("target", "item_id").sortWithinPartitions("target", "item_id", "version", "no", "block")
    return in_order.mapInArrow(_lay_out_items, _PIECE)


def _cut_pieces(range_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = ["target", "item_id", "piece_no", "from_char", "to_char", "size", "n_pieces", "text"]
            rows = []
            for target, item, no, most, before, chunk, n, pieces in zip(*(c.to_pylist() for c in batch.columns)):
                zero = no * max(range_chars, most) - before
                rows += [(target, item, p["piece_no"], p["from_char"], p["to_char"], p["size"], n, chunk[p["from_char"] - zero : p["to_char"] - zero]) for p in pieces]
            kinds = [pa.string(), *[pa.int64()] * 6, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 8, kinds)], names=names)

    return run


def split_items(items: DataFrame, limits: DataFrame, range_chars: int = RANGE_CHARS, halo: int = HALO_CHARS) -> DataFrame:
    """target, item_id, piece_no (from 0), n_pieces, from_char, to_char, size, text of every item above its limit.

    `items` has target, item_id, text; `limits` target, unit ('chars' or 'bytes'), max_size, overlap_size.
    Items within their limit, null texts and targets without a limit give no rows.  An item that is
    delivered more than once counts once; of different texts under one id one counts.
    """
    ranges = cut_lineage(item_ranges(items, limits, range_chars, halo))
    offsets = piece_offsets(ranges, halo)
    counted = offsets.withColumn("n_pieces", F.count(F.lit(1)).over(W.partitionBy("target", "item_id")))
    key = ["target", "item_id", "version", "no"]
    wide = F.greatest(F.lit(range_chars), F.col("max_size"))
    # Pieces of one range: as many as it has characters at most.
    sized = counted.join(limits.where("unit IN ('chars', 'bytes')").select("target", "max_size"), "target").withColumn("no", F.floor(F.col("from_char") / wide).cast("int"))
    grouped = sized.groupBy(*key).agg(F.first("n_pieces").alias("n_pieces"), F.collect_list(F.struct("piece_no", "from_char", "to_char", (F.col("to_unit") - F.col("from_unit")).alias("size"))).alias("pieces"))
    cut = ranges.join(grouped, key).select("target", "item_id", "no", "max_size", "before", "chunk", "n_pieces", "pieces")
    made = cut.mapInArrow(_cut_pieces(range_chars), "target string, item_id bigint, piece_no bigint, from_char bigint, to_char bigint, size bigint, n_pieces bigint, text string")
    return made.select("target", "item_id", "piece_no", "n_pieces", "from_char", "to_char", "size", "text")


def _read_range(path: str, begin: int, end: int) -> bytes:
    with open(path, "rb") as file:
        file.seek(begin)
        return file.read(end - begin)


def _aligned(data: bytes, at: int) -> int:
    """The first place from `at` on where a code point begins."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def split_files(spark: SparkSession, files: DataFrame, max_size: int, overlap: int, range_bytes: int = RANGE_BYTES, halo: int = HALO_BYTES) -> DataFrame:
    """path, piece_no, from_byte, to_byte, text of UTF-8 files too large to load; sizes are in bytes.

    `files` has path (readable by every executor) and n_bytes.  Each worker reads one byte range and its
    halo.  A file without bytes gives no piece; one within max_size gives one.
    """
    ranges = files.where("n_bytes > 0").select("path", "n_bytes", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n_bytes") / range_bytes).cast("int") - 1)).alias("no"))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, n_bytes, no in zip(*(c.to_pylist() for c in batch.columns)):
                begin, end = no * range_bytes, min(n_bytes, (no + 1) * range_bytes)
                low, high = max(0, begin - halo), min(n_bytes, end + halo)
                data = _read_range(path, low, high)
                a, b = _aligned(data, begin - low), _aligned(data, end - low)  # a code point belongs to the range it begins in
                head = data[_aligned(data, 0) : a].decode("utf-8", "surrogateescape")
                own = data[a:b].decode("utf-8", "surrogateescape")
                tail = data[b:].decode("utf-8", "ignore")
                marks = range_marks(head + own + tail, len(head), len(head) + len(own), "bytes").tobytes()
                blocks = [marks[i : i + BLOCK] for i in range(0, len(marks), BLOCK)]
                n = len(blocks)
                yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array([no] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(blocks, pa.binary())], names=["path", "no", "block", "marks"])

    def planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks come in order, file after file; of each file only the layout's state is held."""
        current, layout, n = None, None, 0

        def rows(path: str, pieces: list) -> Iterator[pa.RecordBatch]:
            nonlocal n
            numbers, n = range(n, n + len(pieces)), n + len(pieces)
            columns = [path] * len(pieces), numbers, [p[2] for p in pieces], [p[3] for p in pieces]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.int64()))], names=["path", "piece_no", "from_byte", "to_byte"])

        for batch in batches:
            for path, marks in zip(batch.column("path").to_pylist(), batch.column("marks").to_pylist()):
                if path != current:
                    if layout:
                        yield from rows(current, [layout.rest()])
                    current, layout, n = path, Layout(max_size, overlap), 0
                if pieces := list(layout.marks(np.frombuffer(marks, np.uint8))):
                    yield from rows(path, pieces)
        if layout:
            yield from rows(current, [layout.rest()])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            texts = [_read_range(path, a, b).decode("utf-8", "replace") for path, _, a, b in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

    found = ranges.repartition("path", "no").mapInArrow(marked, "path string, no int, block int, marks binary")
    in_order = found.repartition("path").sortWithinPartitions("path", "no", "block")
    offsets = in_order.mapInArrow(planned, "path string, piece_no int, from_byte bigint, to_byte bigint")
    return offsets.repartition("path", "piece_no").mapInArrow(emit, "path string, piece_no int, from_byte bigint, to_byte bigint, text string")
