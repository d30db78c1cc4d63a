"""Log files: what may be read, decompression by content, directories, samples, reader choice per file.

Paths are Hadoop's: a local disk, HDFS or an object store, whatever the session knows.  Compression is told by magic
number and never by name.  Spark's own text reader takes plain files (and splits them) and gzip or bzip2 files whose
name says so too; what else is compressed is one task's value of 2 GB at most.  Files that one reader takes the
same way are one scan.
"""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import pickle
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incidentlens.sources import bootstrap, detect, readers
from incidentlens.sources import records as R

# How compressed streams and some formats that hold no lines begin.
MAGIC = ((b"\x1f\x8b", "gzip", gzip.open), (b"BZh", "bzip2", bz2.open), (b"\xfd7zXZ\x00", "xz", lzma.open))
BINARY = {
    "an image": (b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff", b"GIF8"),
    "a document of pages": (b"%PDF-",),
    "an archive of files": (b"PK\x03\x04", b"PK\x05\x06"),
    "a database file": (b"SQLite format 3\x00",),
    "columnar data": (b"PAR1", b"ORC"),
    "a compiled program": (b"\x7fELF", b"\xca\xfe\xba\xbe"),
}
#: Folders of tools: none holds an application's log, and each can hold more files than all logs.  Hidden ones (version control,
#: checkers' caches, hidden environments) go by their first letter.
SKIP = frozenset({
    "__pycache__",  # compiled modules
    "node_modules",  # installed packages
    "venv",  # an interpreter with its packages
    "site-packages",  # the same, unpacked elsewhere
})
HEAD, SAMPLE_BYTES, SAMPLE_TEXT = 8192, 1 << 20, 4 << 20
#: Files that the driver looks at by itself, and how many at once.
FEW, READERS_AT_ONCE = 64, 16
#: Names by which Spark's reader knows a compressed file.
SUFFIX = {"gzip": ".gz", "bzip2": ".bz2"}
CODECS = (".gz", ".bz2", ".deflate", ".snappy", ".lz4", ".zst", ".zstd")


class UnreadableSource(ValueError):
    """A source that isn't text."""


def compression_of(head: bytes) -> str | None:
    return next((name for magic, name, _ in MAGIC if head.startswith(magic)), None)


def check_text(name: str, head: bytes) -> None:
    """Refuses binary content, and says what it is."""
    kind = next((what for what, starts in BINARY.items() if head.startswith(starts)), None)
    if kind or b"\0" in head:
        raise UnreadableSource(f"{name} is {kind or 'binary'}, not a text log")


def _located(spark: SparkSession, path):
    """(Hadoop path, its file system)."""
    target = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def read_head(spark: SparkSession, path, size: int) -> bytes:
    """The first bytes of a file on any file system; a file that can't be read is an OSError."""
    from py4j.protocol import Py4JJavaError

    target, system = _located(spark, path)
    try:
        stream = system.open(target)
        try:
            return bytes(stream.readNBytes(size))
        finally:
            stream.close()
    except Py4JJavaError as e:
        raise OSError(f"{path}: {e.java_exception.getMessage()}") from e


def unpacked(data: bytes) -> bytes:
    """What the first bytes of a file hold, decompressed as far as they go."""
    kind = compression_of(data)
    if kind is None:
        return data
    try:
        if kind == "gzip":
            return zlib.decompressobj(wbits=31).decompress(data, SAMPLE_TEXT)
        return (bz2.BZ2Decompressor() if kind == "bzip2" else lzma.LZMADecompressor()).decompress(data, SAMPLE_TEXT)
    except (zlib.error, lzma.LZMAError) as e:
        raise OSError(f"damaged {kind} stream: {e}") from e


def is_blank(raw: bytes) -> bool:
    """Whether a file, all of which was read, has no line of anything but spaces."""
    if len(raw) == SAMPLE_BYTES or unpacked(raw).strip(b" \r\n"):
        return False
    opener = next((o for magic, _, o in MAGIC if raw.startswith(magic)), None)
    text = opener(io.BytesIO(raw)).read(SAMPLE_TEXT) if opener else raw  # behind an empty stream there may be others
    return len(text) < SAMPLE_TEXT and not text.strip(b" \r\n")


def sample(spark: SparkSession, path, n: int = 100) -> list[str]:
    """The first ``n`` lines that aren't blank, in file order, as far as the first megabyte of the file has them."""
    return sample_of(str(path), read_head(spark, path, SAMPLE_BYTES), n)


def sample_of(path: str, raw: bytes, n: int = 100) -> list[str]:
    data = unpacked(raw)
    check_text(path, data[:HEAD])
    lines = data.decode("utf-8", "replace").split("\n")
    if len(lines) > 1 and (len(raw) == SAMPLE_BYTES or len(data) >= SAMPLE_TEXT):
        lines.pop()  # cut off in the middle
    return [line.removesuffix("\r") for line in lines if line.strip()][:n]


def listed(spark: SparkSession, root) -> list[tuple[str, int]]:
    """(path, bytes) of every file below, sorted by its folders and name; hidden names, a writer's marks and build folders are passed over.

    Spark lists the folders, in tasks where there are many.
    """
    target, system = _located(spark, root)
    base = system.makeQualified(target).toString().rstrip("/") + "/"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(root)).select("path", "length").collect()  # a row per file, no contents
    rows = [(r["path"].removeprefix(base).split("/"), r["path"], r["length"]) for r in found]
    return [(path, size) for parts, path, size in sorted(rows) if not any(p.startswith((".", "_")) or p in SKIP for p in parts)]


def log_files(spark: SparkSession, root) -> list[str]:
    """The paths of ``listed``."""
    return [path for path, _ in listed(spark, root)]


def is_folder(spark: SparkSession, path) -> bool:
    target, system = _located(spark, path)
    return system.exists(target) and system.getFileStatus(target).isDirectory()


def file_size(spark: SparkSession, path) -> int:
    from py4j.protocol import Py4JJavaError

    target, system = _located(spark, path)
    try:
        return system.getFileStatus(target).getLen()
    except Py4JJavaError as e:
        raise OSError(f"{path}: {e.java_exception.getMessage()}") from e


def _stream(whole: bool):
    """Compressed contents as numbered lines, or each as one."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                opener = next((o for magic, _, o in MAGIC if content.startswith(magic)), None)
                plain = opener(io.BytesIO(content)) if opener else io.BytesIO(content)
                with io.TextIOWrapper(plain, encoding="utf-8", errors="replace") as f:
                    if whole:
                        yield pd.DataFrame({"source_file": [name], "line_no": [1], "line": [f.read()]})
                        continue
                    chunk, first = [], 1
                    for line in f:
                        chunk.append(line.rstrip("\n"))
                        if len(chunk) == 10_000:
                            yield pd.DataFrame({"source_file": name, "line_no": range(first, first + len(chunk)), "line": chunk})
                            first, chunk = first + len(chunk), []
                    if chunk:
                        yield pd.DataFrame({"source_file": name, "line_no": range(first, first + len(chunk)), "line": chunk})

    return run


def streamed(path, head: bytes) -> bool:
    """Whether Spark's reader can't take the file: its name doesn't say how it is compressed, or says so of a plain one."""
    kind = compression_of(head)
    return str(path).endswith(CODECS) if kind is None else not str(path).endswith(SUFFIX.get(kind, "\0"))


def lines(spark: SparkSession, paths, whole: bool = False) -> DataFrame:
    """source_file, line_no, line of one file or several that are compressed alike; ``whole`` makes each file a single line."""
    paths = [str(p) for p in paths] if isinstance(paths, list) else [str(paths)]
    head = read_head(spark, paths[0], HEAD)
    check_text(paths[0], unpacked(head)[:HEAD])
    if streamed(paths[0], head):
        raw = spark.read.format("binaryFile").load(paths).select(F.col("_metadata.file_path").alias("path"), "content")
        return raw.mapInPandas(_stream(whole), "source_file string, line_no long, line string")
    if whole:
        return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), F.lit(1).cast("long").alias("line_no"), F.col("value").alias("line"))
    return R.read_lines(spark, paths)


def is_document(first_lines: list[str]) -> bool:
    """Whether JSON is spread over lines: no single line of the head is a value."""
    import json

    for line in first_lines[:5]:
        try:
            json.loads(line)
            return False
        except ValueError:
            continue
    return bool(first_lines) and first_lines[0].lstrip()[:1] in "[{"


@dataclass(frozen=True)
class How:
    """How a file is to be read, or why it can't be (``error``).  A ``blank`` one has no line that a reader could be chosen by."""

    reader: str | None = None
    argument: object = None
    confidence: float = 0.0
    whole: bool = False
    streamed: bool = False
    error: str | None = None
    blank: bool = False


@dataclass(frozen=True)
class Choice:
    """What decides a reader: the named one, or what detection and (if allowed) stored and inferred schemas say."""

    name: str | None = None
    allow_bootstrap: bool = False
    year: int | None = None
    clf: bool = False
    known: tuple = ()
    provider: object = None

    def of(self, path: str, raw: bytes) -> tuple[str, object, dict[str, float]]:
        """(reader, its argument, scores) from a file's first bytes."""
        head = sample_of(path, raw, 2 * 400)
        scores = detect.scores(head[:100])
        if self.name is not None:
            readers.reader(self.name)
            return self.name, readers.adopt_shape(head[:400], year=self.year, clf=self.clf) if self.name == "raw_lines" else None, scores
        found, scores = detect.detect(head[:100])
        if found:
            return found, None, scores
        if self.allow_bootstrap and (schema := bootstrap.bootstrap(head[:100], head[100:], list(self.known), self.year, provider=self.provider)):
            return "inferred", schema, scores
        return "raw_lines", readers.adopt_shape(head[:400], year=self.year, clf=self.clf), scores

    def how(self, path: str, raw: bytes) -> How:
        try:
            chosen, argument, scores = self.of(path, raw)
            whole = chosen in ("otlp", "loki", "elastic") and is_document(sample_of(path, raw, 5))
            blank = is_blank(raw)
        except (UnreadableSource, EOFError, OSError) as e:
            return How(error=str(e))
        rate = argument.rate if chosen == "inferred" else scores.get(chosen, 0.0)
        return How(chosen, argument, rate, whole, streamed(path, raw[:HEAD]), blank=blank)


def choose(
    spark: SparkSession, path, name: str | None = None, allow_bootstrap: bool = False, year: int | None = None, clf: bool = False, schemas=None, provider=None,
) -> tuple[str, object, dict[str, float]]:
    """(reader, its argument, scores): the named one, the detected one, a stored or inferred schema (if allowed), else raw lines.

    ``schemas`` is a folder: its schemas are ranked with the inferred one, and a new one that passes is stored there.
    """
    known = tuple(bootstrap.load(spark, schemas)) if schemas and allow_bootstrap else ()
    found = Choice(name, allow_bootstrap, year, clf, known, provider).of(str(path), read_head(spark, path, SAMPLE_BYTES))
    _keep(spark, [found[1]], schemas)
    return found


def _keep(spark: SparkSession, arguments: list, schemas) -> None:
    for schema in arguments:
        if schemas and isinstance(schema, bootstrap.LineSchema) and not schema.origin.startswith("stored"):
            bootstrap.save(spark, schema, schemas)


def _looked_at(spark: SparkSession, files: list[tuple[str, int]], choice: Choice) -> dict[str, How]:
    """How each file is to be read, from one read of its first megabyte.

    Of more than FEW files those that are no longer than that are looked at by tasks; the driver's threads take the others.
    """
    small = [path for path, size in files if size <= SAMPLE_BYTES] if len(files) > FEW and choice.provider is None else []
    out: dict[str, How] = {}
    if small:
        def each(batches: Iterator) -> Iterator:
            import pandas as pd

            for batch in batches:
                yield pd.DataFrame({"path": batch["path"], "how": [pickle.dumps(choice.how(p, c)) for p, c in zip(batch["path"], batch["content"], strict=True)]})

        seen = spark.read.format("binaryFile").load(small).select("path", "content").mapInPandas(each, "path string, how binary")
        out = {r["path"]: pickle.loads(r["how"]) for r in seen.collect()}  # a short row per file

    def one(path: str) -> How:
        try:
            return choice.how(path, read_head(spark, path, SAMPLE_BYTES))
        except OSError as e:
            return How(error=str(e))

    rest = [path for path, _ in files if path not in out]
    with ThreadPoolExecutor(READERS_AT_ONCE) as pool:
        return out | dict(zip(rest, pool.map(one, rest), strict=True))


def read_alike(spark: SparkSession, paths: list[str], chosen: str, argument, whole: bool, year: int | None = None, clf: bool = False) -> DataFrame:
    """Records of files that one reader takes the same way: one scan."""
    table = lines(spark, paths, whole)
    if chosen == "inferred":
        return bootstrap.read(table, argument, year)
    if chosen == "raw_lines":
        return readers.raw_lines(table, argument, year, clf)
    return readers.json_lines(table, year) if chosen == "json_lines" else readers.reader(chosen)(table)


def read_source(spark: SparkSession, source, name: str | None = None, allow_bootstrap: bool = False, year: int | None = None, clf: bool = False, schemas=None, provider=None, told: list | None = None) -> tuple[DataFrame, list[tuple[str, str]], list[str]]:
    """(records, (file, reader) pairs, why files were passed over) of a file or a folder; a folder without a readable file is an error.

    Blank files hold no record: in a folder with others they are left out.

    ``told`` is given a dict for every file read: path, reader, argument, confidence, bytes.
    """
    folder = is_folder(spark, source)
    known = tuple(bootstrap.load(spark, schemas)) if schemas and allow_bootstrap else ()
    files = listed(spark, source) if folder else [(str(source), file_size(spark, source))]
    hows = _looked_at(spark, files, Choice(name, allow_bootstrap, year, clf, known, provider))
    _keep(spark, [h.argument for h in hows.values()], schemas)
    groups, used, skipped = {}, [], []
    if any(not how.blank and how.error is None for how in hows.values()):  # beside files with lines a blank one is no log that no reader knew
        files = [(path, size) for path, size in files if not hows[path].blank]
    for path, size in files:
        how = hows[path]
        if how.error is not None:
            if not folder:
                raise UnreadableSource(how.error)
            skipped.append(f"{path}: {how.error}")
            continue
        groups.setdefault((how.reader, repr(how.argument), how.whole, how.streamed), (how.argument, []))[1].append(path)
        used.append((path, how.reader))
        if told is not None:
            told.append({"path": path, "reader": how.reader, "argument": how.argument, "confidence": how.confidence, "bytes": size})
    if not groups:
        raise UnreadableSource(f"nothing to read in {source}")
    parts = {key: read_alike(spark, paths, key[0], argument, key[2], year, clf) for key, (argument, paths) in groups.items()}
    return (readers.union_files(parts) if folder else next(iter(parts.values()))), used, skipped


def number_events(records: DataFrame) -> DataFrame:
    """Good records with ``id``: their place in order of file and line.  Files are numbered from sums per block of lines, not in one task.

    Where every line of a block is one record, its number says its place; only records of other blocks are sorted.
    """
    from pyspark.sql import Window

    good = records.where("status = 'ok'").withColumn("_b", F.expr("bitmap_bucket_number(line_no)"))  # blocks of 32,768 lines
    distinct = F.expr("bitmap_count(bitmap_construct_agg(bitmap_bit_position(line_no)))")
    sizes = good.groupBy("source_file", "_b").agg(F.count("*").alias("n"), distinct.alias("distinct"), F.min("line_no").alias("lo"), F.max("line_no").alias("hi"))
    before = Window.orderBy("source_file", "_b").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    whole = F.coalesce((F.col("n") == F.col("distinct")) & (F.col("n") == F.col("hi") - F.col("lo") + 1), F.lit(False))
    base = sizes.select(F.col("source_file").alias("_f"), F.col("_b").alias("_bb"), "lo", whole.alias("_whole"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    joined = good.join(F.broadcast(base), F.col("source_file").eqNullSafe(F.col("_f")) & F.col("_b").eqNullSafe(F.col("_bb")))
    within = F.row_number().over(Window.partitionBy("source_file", "_b").orderBy("line_no", "raw"))
    columns = [c for c in records.columns if c != "status"]
    told = joined.where("_whole").select((F.col("base") + F.col("line_no") - F.col("lo") + 1).alias("id"), *columns)
    others = joined.where("not _whole").withColumn("_rn", within).select((F.col("base") + F.col("_rn")).alias("id"), *columns)
    return told.unionByName(others)
