"""BAM: BGZF blocks decoded to alignments, and alignments encoded to BGZF."""

from __future__ import annotations

import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.sources.bgzf import BLOCK, EOF, block, blocks, inflate
from cladeframe.sources.sinks import target, write_packed

#: Fixed values of the public format.
BASES, OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
_INT = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I"}
#: What blocks of the public tools begin with, up to the length; blocks of a split that are looked at for its first record.
BLOCK_START, HEAD_BLOCKS = EOF[:16], 64
#: Bytes that a record may have where its place must be told.
LONGEST = 1 << 28
#: The bin of the public index format that holds counts.
SUMMARY_BIN = 37450
_FIXED = struct.Struct("<iiiBBHHHiiii")
SCHEMA = "ord long, qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string, tags array<struct<tag:string,type:string,value:string>>"
_FIELDS = [f.split(" ", 1)[0] for f in SCHEMA.split(", ")]
_TAG = pa.list_(pa.struct([("tag", pa.string()), ("type", pa.string()), ("value", pa.string())]))
_TYPES = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), _TAG]


def deflate(data: bytes, level: int = 5) -> bytes:
    """BGZF blocks and the end marker."""
    return b"".join([*blocks(data, level), EOF])


def split_header(data: bytes) -> tuple[list[str], list[str], int]:
    """Header lines, reference names, and where the records begin."""
    if data[:4] != b"BAM\x01":
        raise ValueError("not a BAM file: bad magic")
    n = struct.unpack_from("<i", data, 4)[0]
    text = data[8 : 8 + n].rstrip(b"\0").decode()
    at, names = 12 + n, []
    for _ in range(struct.unpack_from("<i", data, 8 + n)[0]):
        k = struct.unpack_from("<i", data, at)[0]
        names.append(data[at + 4 : at + 3 + k].decode())
        at += 8 + k
    return text.splitlines(), names, at


def _tags(data: bytes, at: int, end: int) -> list[dict]:
    out = []
    while at < end:
        tag, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in _INT:
            value, size, kind = struct.unpack_from(_INT[kind], data, at)[0], struct.calcsize(_INT[kind]), "i"
        elif kind == "A":
            value, size = chr(data[at]), 1
        elif kind == "f":
            value, size = f"{struct.unpack_from('<f', data, at)[0]:g}", 4
        elif kind in "ZH":
            stop = data.index(b"\0", at)
            value, size = data[at:stop].decode(), stop + 1 - at
        else:
            sub, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            form = "<f" if sub == "f" else _INT[sub]
            width = struct.calcsize(form)
            each = [struct.unpack_from(form, data, at + 5 + k * width)[0] for k in range(n)]
            value, size = ",".join([sub, *(f"{x:g}" if sub == "f" else str(x) for x in each)]), 5 + n * width
        out.append({"tag": tag, "type": kind, "value": str(value)})
        at += size
    return out


def record(data, at: int, names: list[str]) -> tuple[tuple, int]:
    """The alignment that begins at a place, in the order of SCHEMA without ord, and where it ends."""
    ref = lambda k: names[k] if k >= 0 else None
    size, ref_id, pos, l_name, mapq, _, n_ops, flag, l_seq, next_ref, next_pos, tlen = _FIXED.unpack_from(data, at)
    end, p = at + 4 + size, at + 36
    name = data[p : p + l_name - 1].decode()
    p += l_name
    cigar = "".join(f"{x >> 4}{OPS[x & 15]}" for x in struct.unpack_from(f"<{n_ops}I", data, p))
    p += 4 * n_ops
    packed = data[p : p + (l_seq + 1) // 2]
    seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:l_seq]
    p += len(packed)
    qual = data[p : p + l_seq]
    p += l_seq
    other = "*" if next_ref < 0 else "=" if next_ref == ref_id else names[next_ref]
    quality = "*" if not qual or qual[0] == 255 else bytes(q + 33 for q in qual).decode()
    return (name if name != "*" else None, flag, ref(ref_id), pos + 1 if pos >= 0 else None, mapq, cigar or None, other, next_pos + 1, tlen, seq, quality, _tags(data, p, end)), end


def records(data: bytes):
    """Alignments of an inflated file as tuples in the order of SCHEMA."""
    _, names, at = split_header(data)
    ord_ = 0
    while at < len(data):
        one, at = record(data, at, names)
        yield ord_, *one
        ord_ += 1


def _plausible(data: bytes, at: int, n_refs: int) -> int | None:
    """Where a record that begins here would end, if what can be seen of it may be one; past the data if it is cut."""
    if at + 36 > len(data):
        return len(data) + 1
    size, ref_id, pos, l_name, _, _, n_ops, _, l_seq, next_ref, next_pos, _ = _FIXED.unpack_from(data, at)
    if l_name < 1 or l_seq < 0 or 32 + l_name + 4 * n_ops + (l_seq + 1) // 2 + l_seq > size or size > LONGEST:
        return None
    if not (-1 <= ref_id < n_refs and -1 <= next_ref < n_refs and pos >= -1 and next_pos >= -1):
        return None
    name = data[at + 36 : at + 36 + l_name]
    if len(name) == l_name and (name[-1] or not all(33 <= c <= 126 for c in name[:-1])):
        return None
    ops = data[at + 36 + l_name : at + 36 + l_name + 4 * n_ops : 4]
    return at + 4 + size if all(c & 15 < len(OPS) for c in ops) else None


def first_record(data: bytes, n_refs: int, closed: bool = False) -> int | None:
    """The first place from which plausible records follow each other to the end of the data, if there is one.

    The last of them may be cut, unless the data is closed; closed data may also end without any.
    """
    for begin in range(len(data) + closed):
        at: int | None = begin
        while at is not None and at < len(data):
            at = _plausible(data, at, n_refs)
        if at is not None and (at == len(data) or not closed):
            return begin
    return None


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    """part, id, block: the BGZF blocks of a file without the fixed bytes they begin with, which split it like lines."""
    blocks = spark.read.option("encoding", "ISO-8859-1").option("lineSep", BLOCK_START.decode("latin-1")).text(path)
    place = F.monotonically_increasing_id()
    return blocks.select(F.shiftright(place, 33).cast("int").alias("part"), place.alias("id"), F.col("value").cast("binary").alias("block"))


def _body(block: bytes) -> bytes:
    """What a block without its first 16 bytes holds; a block of another length than it says is no block."""
    if not block:
        return b""
    if struct.unpack_from("<H", block)[0] + 1 != len(block) + len(BLOCK_START):
        raise ValueError("malformed BGZF block")
    return zlib.decompress(block[2:-8], -15)


def _start(blocks: DataFrame) -> tuple[list[str], list[str], int]:
    """Header lines, reference names and where the records begin, from as many of the first blocks as that takes."""
    n = 16
    while True:
        some = sorted(blocks.limit(n).collect())
        data = b"".join(_body(bytes(r.block)) for r in some)
        try:
            header, names, at = split_header(data)
            if at <= len(data):
                return header, names, at
        except (struct.error, UnicodeDecodeError):
            pass
        if len(some) < n:
            raise ValueError("malformed BAM header")
        n *= 8


def read_bam(spark: SparkSession, path: str) -> tuple[list[str], DataFrame]:
    """Header lines and alignments, ord rising in the order of the file.

    A BGZF file is split like a text whose lines are its blocks. Where the first record of a split begins is told by
    a chain of plausible records in its first blocks; the bytes before it, less than a record for each split, go to
    the driver and complete the last record of the split before. That the last record must end right there proves
    every beginning by the one before it, from the header on; where it doesn't, the read fails. A stream that isn't
    made of such blocks, or has a split without a beginning to be found, is decoded by one task, below 2 GB.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    blocks = _blocks(spark, path)
    if not [r for r in blocks.limit(1).collect() if not r.block]:  # a file of blocks begins with one
        return _read_whole(files)
    header, names, begin = _start(blocks)
    n_refs = len(names)

    def heads(batches):
        data: dict[int, list[bytes]] = {}
        for batch in batches:
            for part, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data.setdefault(part, []).append(_body(block))
        rows = []
        for part, pieces in data.items():
            whole = b"".join(pieces)
            for closed in (False, True):
                if part and not (closed and len(pieces) == HEAD_BLOCKS):
                    at = first_record(whole, n_refs, closed)
                    rows.append((part, closed, None if at is None else whole[:at]))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.bool_(), pa.binary()))], names=["part", "closed", "head"])

    first = blocks.where(F.col("id").bitwiseAND(F.lit((1 << 33) - 1)) < HEAD_BLOCKS)
    found = {(r.part, r.closed): r.head for r in first.select("part", "block").mapInArrow(heads, "part int, closed boolean, head binary").collect()}
    parts = sorted({p for p, _ in found})
    last = parts[-1] if parts else 0
    after = {p: found.get((p, True), found[p, False]) if p == last else found[p, False] for p in parts}
    if any(h is None for h in after.values()):
        return _read_whole(files)
    skip = {0: begin} | {p: len(h) for p, h in after.items()}
    after = {p: bytes(after[q]) for p, q in zip([0, *parts], parts, strict=False)}

    def decode(batches):
        pending, part, rows, n = b"", None, [], 0

        def take(data: bytes):
            nonlocal n
            at = 0
            while at + 4 <= len(data) and at + 4 + (size := struct.unpack_from("<i", data, at)[0]) <= len(data):
                if size < 32:
                    raise ValueError("malformed BAM record")
                one, at = record(data, at, names)
                rows.append(((part << 33) + n, *one))
                n += 1
            return data[at:]

        for batch in batches:
            for part_, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = _body(block)
                if part is None:
                    part, todo = part_, skip[part_]
                if todo:
                    todo, data = todo - min(todo, len(data)), data[todo:]
                pending = take(pending + data)
                if len(rows) >= 10000:
                    yield _batch(rows)
                    rows.clear()
        if part is not None:
            if todo:
                raise ValueError("the header of the BAM file is longer than a split")
            rest = take(pending + after.get(part, b""))
            if rest:
                raise ValueError("truncated BAM file" if part == last else "a split of the BAM file does not end where the next begins")
            yield _batch(rows)

    return header, blocks.select("part", "block").mapInArrow(decode, SCHEMA)


def _read_whole(files: DataFrame) -> tuple[list[str], DataFrame]:
    """Header lines and alignments of a file that one task decodes."""

    def header(batches):
        for batch in batches:
            for blob in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(["\n".join(split_header(inflate(blob.as_py()))[0])])], names=["text"])

    def decode(batches):
        for batch in batches:
            for blob in batch.column(0):
                part = []
                for r in records(inflate(blob.as_py())):
                    part.append(r)
                    if len(part) == 10000:
                        yield _batch(part)
                        part = []
                yield _batch(part)

    text = files.mapInArrow(header, "text string").first()[0]
    return text.splitlines(), files.mapInArrow(decode, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _FIELDS]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=_FIELDS)


def encode_header(header: list[str]) -> tuple[bytes, dict[str, int]]:
    text = "".join(f"{h}\n" for h in header).encode()
    refs = [dict(f.split(":", 1) for f in h.split("\t")[1:]) for h in header if h.startswith("@SQ")]
    out = [b"BAM\x01", struct.pack("<i", len(text)), text, struct.pack("<i", len(refs))]
    for r in refs:
        name = r["SN"].encode() + b"\0"
        out += [struct.pack("<i", len(name)), name, struct.pack("<i", int(r["LN"]))]
    return b"".join(out), {r["SN"]: k for k, r in enumerate(refs)}


def _encode_tag(tag: str, kind: str, value: str) -> bytes:
    head = tag.encode()
    if kind == "i":
        n = int(value)
        return head + (b"i" + struct.pack("<i", n) if n < 2**31 else b"I" + struct.pack("<I", n))
    if kind == "A":
        return head + b"A" + value.encode()
    if kind == "f":
        return head + b"f" + struct.pack("<f", float(value))
    if kind in "ZH":
        return head + kind.encode() + value.encode() + b"\0"
    sub, *each = value.split(",")
    form = "<f" if sub == "f" else _INT[sub]
    return head + b"B" + sub.encode() + struct.pack("<i", len(each)) + b"".join(struct.pack(form, float(x) if sub == "f" else int(x)) for x in each)


def _bin(start: int, end: int) -> int:
    """Index bin of a region, as the public format defines it."""
    end -= 1
    for shift, base in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if start >> shift == end >> shift:
            return base + (start >> shift)
    return 0


def encode_record(r, refs: dict[str, int]) -> bytes:
    ops = []
    n = ""
    for c in r["cigar"] or "":
        if c.isdigit():
            n += c
        else:
            ops.append((int(n), c))
            n = ""
    pos = (r["pos"] or 0) - 1
    span = sum(k for k, c in ops if c in "M=XDN") or 1
    ref = refs[r["rname"]] if r["rname"] else -1
    other = ref if r["rnext"] == "=" else -1 if r["rnext"] in (None, "*") else refs[r["rnext"]]
    name = (r["qname"] or "*").encode() + b"\0"
    codes = [BASES.find(c) if c in BASES else 15 for c in r["seq"].upper()] + [0] * (len(r["seq"]) % 2)
    qual = b"\xff" * len(r["seq"]) if r["qual"] in (None, "*") else bytes(ord(c) - 33 for c in r["qual"])
    body = b"".join(
        [
            struct.pack("<iiBBHHHiiii", ref, pos, len(name), r["mapq"] or 0, _bin(max(pos, 0), max(pos, 0) + span), len(ops), r["flag"], len(r["seq"]), other, (r["pnext"] or 0) - 1, r["tlen"] or 0),
            name, struct.pack(f"<{len(ops)}I", *(k << 4 | OPS.index(c) for k, c in ops)), bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True)), qual, *(_encode_tag(t["tag"], t["type"], t["value"]) for t in r["tags"] or ()),
        ]
    )
    return struct.pack("<i", len(body)) + body


class Index:
    """The public index of a sorted file: per reference the chunks of its bins and where its 16 kb windows begin.

    Offsets are counted in the inflated file, and told as virtual ones when all blocks are written.
    """

    def __init__(self, n_refs: int):
        self.bins: list[dict[int, list[list[int]]]] = [{} for _ in range(n_refs)]
        self.windows: list[dict[int, int]] = [{} for _ in range(n_refs)]
        self.counts, self.unplaced = [[0, 0] for _ in range(n_refs)], 0

    def add(self, encoded: bytes, begin: int) -> None:
        _, ref, pos, l_name, _, bin_, n_ops, flag, *_ = _FIXED.unpack_from(encoded)
        if ref < 0 or pos < 0:
            self.unplaced += 1
            return
        ops = struct.unpack_from(f"<{n_ops}I", encoded, 36 + l_name)
        last = pos + max(1, sum(x >> 4 for x in ops if OPS[x & 15] in "M=XDN")) - 1
        chunks = self.bins[ref].setdefault(bin_, [])
        if chunks and chunks[-1][1] // BLOCK >= begin // BLOCK:
            chunks[-1][1] = begin + len(encoded)
        else:
            chunks.append([begin, begin + len(encoded)])
        for w in range(pos >> 14, (last >> 14) + 1):
            self.windows[ref].setdefault(w, begin)
        self.counts[ref][flag >> 2 & 1] += 1

    def encode(self, blocks: list[int]) -> bytes:
        """blocks has where each block of the file begins, the end marker too."""
        place = lambda at: blocks[at // BLOCK] << 16 | at % BLOCK
        out = [b"BAI\x01", struct.pack("<i", len(self.bins))]
        for bins, windows, counts in zip(self.bins, self.windows, self.counts, strict=True):
            out.append(struct.pack("<i", len(bins) + bool(bins)))
            for bin_, chunks in sorted(bins.items()):
                out.append(struct.pack("<Ii", bin_, len(chunks)) + b"".join(struct.pack("<QQ", place(a), place(b)) for a, b in chunks))
            if bins:
                ends = [x for chunks in bins.values() for c in chunks for x in c]
                out.append(struct.pack("<Ii4Q", SUMMARY_BIN, 2, place(min(ends)), place(max(ends)), *counts))
            at, linear = 0, []
            for w in range(max(windows, default=-1) + 1):
                at = place(windows[w]) if w in windows else at
                linear.append(at)
            out.append(struct.pack(f"<i{len(linear)}Q", len(linear), *linear))
        return b"".join([*out, struct.pack("<Q", self.unplaced)])


def write_bam(alignments: DataFrame, header: list[str], path: str, level: int = 5, index: bool = False) -> None:
    """One local file or standard output in the order of ord, and a file's index at path.bai if asked for.

    Executors encode and compress; the driver writes the pieces. Only with an index, whose offsets run through the
    whole file, do the rows stream through the driver.
    """
    head, refs = encode_header(header)
    if not index:

        def encode(batch):
            for row in batch.to_pylist():
                yield encode_record(row, refs)

        write_packed(alignments, path, encode, level, b"".join(blocks(head, level)), EOF)
        return
    found, begins = Index(len(refs)), [0]
    with target(path) as f:
        pending, size, done = bytearray(head), len(head), 0

        def flush(last: bool) -> int:
            cut, wrote = len(pending) if last else len(pending) // BLOCK * BLOCK, 0
            for at in range(0, cut, BLOCK):
                wrote += f.write(block(bytes(pending[at : min(at + BLOCK, cut)]), level))
                begins.append(done + wrote)
            del pending[:cut]
            return wrote

        for r in alignments.orderBy("ord").toLocalIterator():
            one = encode_record(r, refs)
            found.add(one, size)
            pending += one
            size += len(one)
            if len(pending) > 1 << 22:
                done += flush(False)
        flush(True)
        f.write(EOF)
    with target(f"{path}.bai") as f:
        f.write(found.encode(begins))


def text_lines(alignments: DataFrame) -> DataFrame:
    """ord, value: SAM record lines."""
    from cladeframe.functions.tags import format_tags

    star = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("*"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    tags = F.when(F.size("tags") > 0, format_tags(F.col("tags")))
    return alignments.select("ord", F.concat_ws("\t", star("qname"), zero("flag"), star("rname"), zero("pos"), zero("mapq"), star("cigar"), star("rnext"), zero("pnext"), zero("tlen"), star("seq"), star("qual"), tags).alias("value"))
