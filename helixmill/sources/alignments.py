"""Alignment sources: SAM text and BAM.

Records become the canonical table: rec_ord, qname, flag, tid, contig, pos (0-based), mapq, cigar,
mtid, mpos, tlen, seq, qual, nh, hi, nm, and the flag's duplicate and primary bits as columns, so
that filters on them reach Parquet's statistics. save() writes it partitioned by contig. CRAM is
not read: it needs a codec and a reference server that this engine does not have.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import flags

# Fixed values of the BAM format: the codes of bases and operations, and the sizes of tag values.
BASES, OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
TAG_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
TAG_CODES = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}


def contigs(lines: DataFrame, prefix: str = "", names: dict[str, str] | None = None) -> DataFrame:
    """Tid, name, length and gtf_name from @SQ lines (value, line): an explicit name, else prefix and name."""
    sq = lines.where(F.col("value").startswith("@SQ\t"))
    name, length = F.regexp_extract("value", "\tSN:([^\t]+)", 1), F.regexp_extract("value", "\tLN:([0-9]+)", 1).cast("long")
    tid = F.row_number().over(Window.orderBy("line")) - 1  # a row for each contig
    return sq.select(tid.alias("tid"), name.alias("name"), length.alias("length"), translated(name, prefix, names).alias("gtf_name"))


def translated(name: Column, prefix: str = "", names: dict[str, str] | None = None) -> Column:
    out = F.concat(F.lit(prefix), name)
    for own, other in (names or {}).items():
        out = F.when(name == own, other).otherwise(out)
    return out


def _tag(tags: Column, name: str) -> Column:
    """An integer tag of any width."""
    return F.regexp_extract(tags, rf"(?:^|\t){name}:i:(-?\d+)", 1).try_cast("int")


def _marked(df: DataFrame) -> DataFrame:
    return df.withColumn("is_dup", flags.has(flags.DUPLICATE)).withColumn("is_primary", flags.primary())


def read_sam(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Alignments and contigs of SAM text. rec_ord follows the file's order."""
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
    head = contigs(lines)
    f = F.split("value", "\t")
    tags = F.array_join(F.slice(f, 12, 1000), "\t")
    rows = lines.where(~F.col("value").startswith("@") & (F.col("value") != "")).select(
        F.col("line").alias("rec_ord"), f[0].alias("qname"), f[1].cast("int").alias("flag"), f[2].alias("contig"), (f[3].cast("long") - 1).alias("pos"), f[4].cast("int").alias("mapq"),
        f[5].alias("cigar"), F.when(f[6] == "=", f[2]).otherwise(f[6]).alias("mcontig"), (f[7].cast("long") - 1).alias("mpos"), f[8].cast("long").alias("tlen"), f[9].alias("seq"), f[10].alias("qual"),
        _tag(tags, "NH").alias("nh"), _tag(tags, "HI").alias("hi"), _tag(tags, "NM").alias("nm"),
    )
    ids = head.select(F.col("name").alias("contig"), "tid")
    both = rows.join(ids, "contig", "left").join(ids.select(F.col("contig").alias("mcontig"), F.col("tid").alias("mtid")), "mcontig", "left")
    return _marked(both.drop("mcontig")), head


class Blocks:
    """The uncompressed bytes of a BGZF file (each block a gzip member with its size in its header), from a block on. Plain gzip members are read too."""

    def __init__(self, handle, at: int = 0):
        self.handle, self.at, self.buffer, self.place = handle, at, b"", 0
        handle.seek(at)

    def more(self) -> bool:
        """Reads the next block behind what is left of this one."""
        head = self.handle.read(18)
        if len(head) < 18:
            return False
        if head[:2] != b"\x1f\x8b":
            raise ValueError("not a compressed block")
        left = self.buffer[self.place :]
        self.start = self.at
        if head[3] & 4 and head[12:14] == b"BC":
            size = struct.unpack_from("<H", head, 16)[0] + 1
            text = zlib.decompress(self.handle.read(size - 18)[:-8], -15)
            self.at += size
        else:  # its end is found by unpacking
            d, part, texts, size = zlib.decompressobj(31), head, [], 0
            while part and not d.eof:
                texts.append(d.decompress(part))
                size += len(part)
                part = b"" if d.eof else self.handle.read(1 << 16)
            text = b"".join(texts)
            self.at += size - len(d.unused_data)
            self.handle.seek(self.at)
        self.buffer, self.place, self.carried = left + text, 0, len(left)
        return True

    def take(self, n: int) -> bytes | None:
        while len(self.buffer) - self.place < n:
            if not self.more():
                if self.place < len(self.buffer):
                    raise ValueError("the file ends within a record")
                return None
        self.place += n
        return self.buffer[self.place - n : self.place]


def opened(path: str):
    """A file that can be read from any place, in any store that Arrow reaches."""
    from pyarrow import fs

    where = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path
    store, name = fs.FileSystem.from_uri(where) if "://" in where else (fs.LocalFileSystem(), where)
    return store.open_input_file(name)


def _tags(raw: bytes) -> dict[str, int]:
    out, at = {}, 0
    while at + 3 <= len(raw):
        name, kind = raw[at : at + 2].decode(), chr(raw[at + 2])
        at += 3
        if kind in TAG_SIZES:
            if kind in TAG_CODES and kind != "f":
                out[name] = struct.unpack_from("<" + TAG_CODES[kind], raw, at)[0]
            at += TAG_SIZES[kind]
        elif kind in "ZH":
            at = raw.index(b"\0", at) + 1
        elif kind == "B":
            n = struct.unpack_from("<i", raw, at + 1)[0]
            at += 5 + n * TAG_SIZES[chr(raw[at])]
        else:
            break
    return out


def bam_contigs(blocks: Blocks) -> list[tuple[str, int]]:
    """Names and lengths from the head of a BAM file; leaves the blocks at its first record."""
    whole = lambda: struct.unpack("<i", blocks.take(4) or b"\0\0\0\0")[0]
    if blocks.take(4) != b"BAM\x01":
        raise ValueError("not a BAM file")
    blocks.take(whole())
    refs = []
    for _ in range(whole()):
        name = blocks.take(whole())[:-1].decode()
        refs.append((name, whole()))
    return refs


def bam_records(blocks: Blocks, refs: list[tuple[str, int]], most: int | None = None) -> Iterator[tuple]:
    """At most `most` records from here on."""
    done = 0
    while (most is None or done < most) and (size := blocks.take(4)):
        raw = blocks.take(struct.unpack("<i", size)[0])
        if raw is None:
            raise ValueError("the file ends within a record")
        done += 1
        tid, pos, n_name, mapq, _, n_ops, flag, n_seq, mtid, mpos, tlen = struct.unpack_from("<iiBBHHHiiii", raw)
        at = 32 + n_name
        name = raw[32 : at - 1].decode()
        cigar = "".join(f"{v >> 4}{OPS[v & 15]}" for v in struct.unpack_from(f"<{n_ops}I", raw, at)) or "*"
        at += 4 * n_ops
        packed = raw[at : at + (n_seq + 1) // 2].hex()
        seq = packed[:n_seq].translate(_BASE_OF) or "*"
        at += (n_seq + 1) // 2
        q = raw[at : at + n_seq]
        qual = "*" if not q or q[0] == 255 else q.translate(_SHOWN).decode("latin-1")
        tags = _tags(raw[at + n_seq :])
        yield name, flag, tid, refs[tid][0] if tid >= 0 else "*", pos, mapq, cigar, mtid, mpos, tlen, seq, qual, tags.get("NH"), tags.get("HI"), tags.get("NM")


_BASE_OF = str.maketrans("0123456789abcdef", BASES)
_SHOWN = bytes(min(255, x + 33) for x in range(256))


def decode_bam(data: bytes) -> tuple[list[tuple[str, int]], Iterator[tuple]]:
    """Contigs and records of a BAM file."""
    blocks = Blocks(io.BytesIO(data))
    refs = bam_contigs(blocks)
    return refs, bam_records(blocks, refs)


def bam_parts(handle, records: int = 1 << 17) -> Iterator[tuple[int, int, int, int]]:
    """Parts of a BAM file of `records` records: the place of a block, how many of its bytes come first, the part's first record and how many it has."""
    blocks = Blocks(handle)
    bam_contigs(blocks)
    start, done = None, 0
    while True:
        if blocks.place == len(blocks.buffer) and not blocks.more():
            break
        # what is left of earlier blocks is a record's beginning: a part begins where none is
        if blocks.place >= blocks.carried and (start is None or done - start[2] >= records):
            if start:
                yield (*start, done - start[2])
            start = (blocks.start, blocks.place - blocks.carried, done)
        size = blocks.take(4)
        if not size:
            break
        blocks.take(struct.unpack("<i", size)[0])
        done += 1
    if start and done > start[2]:
        yield (*start, done - start[2])


BAM_COLUMNS = ["qname", "flag", "tid", "contig", "pos", "mapq", "cigar", "mtid", "mpos", "tlen", "seq", "qual", "nh", "hi", "nm"]
#: Bits of a record's number within its file; the file's number lies above them.
ORDER_BITS = 40


def read_bam(spark: SparkSession, path: str, records: int = 1 << 17) -> tuple[DataFrame, DataFrame]:
    """Alignments and contigs of BAM files. rec_ord is the number of the file (by name) and of the record in it.

    One task a file walks its blocks and notes where parts begin, without decoding records; the parts
    are then decoded by as many tasks. No file is read as one row.
    """
    names = sorted(r.path for r in spark.read.format("binaryFile").load(path).select("path").collect())  # names, not contents
    files = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "file long, path string").repartition(max(1, len(names)), "file")

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, name in batch.itertuples(index=False):
                with opened(name) as handle:
                    yield pd.DataFrame([(file, name, *p) for p in bam_parts(handle, records)], columns=["file", "path", "at", "skip", "first", "n"])

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, name, at, skip, first, n in batch.itertuples(index=False):
                with opened(name) as handle:
                    refs = bam_contigs(Blocks(handle))
                    blocks = Blocks(handle, at)
                    blocks.take(skip)
                    part: list[tuple] = []
                    for k, r in enumerate(bam_records(blocks, refs, n)):
                        part.append(((file << ORDER_BITS) + first + k, *r))
                        if len(part) == 20_000 or k == n - 1:
                            yield pd.DataFrame(part, columns=["rec_ord", *BAM_COLUMNS]).astype({c: "Int64" for c in ("nh", "hi", "nm")})
                            part = []

    schema = "rec_ord long, qname string, flag int, tid int, contig string, pos long, mapq int, cigar string, mtid int, mpos long, tlen long, seq string, qual string, nh int, hi int, nm int"

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, name in batch.itertuples(index=False):
                with opened(name) as handle:
                    refs = bam_contigs(Blocks(handle))
                yield pd.DataFrame([(k, n, size, n) for k, (n, size) in enumerate(refs)], columns=["tid", "name", "length", "gtf_name"])

    parts = files.mapInPandas(index, "file long, path string, at long, skip long, first long, n long")
    dealt = parts.repartition(spark.sparkContext.defaultParallelism * 4, "file", "first")
    return _marked(dealt.mapInPandas(rows, schema)), files.mapInPandas(heads, "tid int, name string, length long, gtf_name string").distinct()


def save(reads: DataFrame, path: str) -> None:
    """The alignment table as Parquet by contig; a contig's records are spread over files by position."""
    spread = reads.repartition("contig", F.floor(F.col("pos") / 5_000_000))
    spread.sortWithinPartitions("contig", "pos").write.mode("overwrite").partitionBy("contig").parquet(path)


def quality(c: str = "qual") -> Column:
    """Base qualities as array<int>."""
    return F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x) - 33)
