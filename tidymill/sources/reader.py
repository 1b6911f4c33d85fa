"""Reading delimited text or Parquet with everything as text, then promoting columns on evidence."""
import csv
import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

DELIMITERS = (",", ";", "\t", "|")
ENCODINGS = ("utf-8", "ISO-8859-1", "windows-1252")
BOOLEAN_WORDS = ("true", "false", "yes", "no", "y", "n")


#: Room for the records of a file in a row id.
RECORD_BITS = 40


def headerless(names):
    """SRC-02: at least 70 % of the header cells are numbers, so the first line is data."""
    cells = [n.strip().strip('"') for n in names]
    return sum(bool(re.fullmatch(r"[+-]?\d+(\.\d+)?", c)) for c in cells) >= 0.7 * len(cells)


def file_facts(spark, path):
    """SRC-01, one row per file, over all its lines: first line, delimiter, whether it is valid UTF-8, and whether a quoted cell runs over a line end.

    The delimiter is the one that splits the lines most evenly outside quotes: most lines with its commonest number of cells, then most cells.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("place"), "value")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    filled = F.trim(F.col("value")) != ""
    facts = raw.groupBy("file").agg((F.count_if(~F.is_valid_utf8("value")) == 0).alias("utf8"), (F.count_if(quotes % 2 == 1) > 0).alias("open_quotes"),
                                    F.min_by(F.col("value").cast("binary"), F.when(filled, F.col("place"))).alias("head"))
    bare = F.regexp_replace("value", '"[^"]*"', "")
    marks = [F.struct(F.lit(-i).alias("order"), F.lit(d).alias("sep"), (F.length(bare) - F.length(F.replace(bare, F.lit(d), F.lit("")))).alias("n")) for i, d in enumerate(DELIMITERS)]
    counted = raw.filter(filled).select("file", F.explode(F.array(*marks)).alias("m")).groupBy("file", "m").agg(F.count("*").alias("lines"))
    usual = counted.groupBy("file", "m.sep", "m.order").agg(F.max(F.struct("lines", "m.n")).alias("u"))
    score = F.struct(F.col("u.n") > 0, F.when(F.col("u.n") > 0, F.col("u.lines")).otherwise(0), F.col("u.n"), F.col("order"))
    return facts.join(usual.groupBy("file").agg(F.max_by("sep", score).alias("sep")), "file", "left").orderBy("file").collect()


def header_cells(line, sep):
    """Cells of a header line; a separator inside quotes does not part them."""
    return next(csv.reader([line], delimiter=sep), [])


def _layouts(spark, path, sep, encoding):
    """{(encoding, quoted line ends, delimiter, columns, has a header): files}, and all files in order."""
    layouts, files = {}, []
    for f in file_facts(spark, path):
        name, mark = unquote(f["file"]), sep or f["sep"] or DELIMITERS[0]
        code = encoding or (ENCODINGS[0] if f["utf8"] else ENCODINGS[1])
        files.append(name)
        cells = header_cells(bytes(f["head"] or b"").decode(code).removeprefix("\ufeff"), mark)
        bare = bool(cells) and headerless(cells)
        columns = tuple(f"col_{i}" for i in range(len(cells))) if bare else tuple(_unique(cells))
        if columns:
            layouts.setdefault((code, f["open_quotes"], mark, columns, not bare), []).append(name)
    return layouts, files


def _records(spark, path, rid, sep, encoding):
    """All records as text under the columns of all files, with `_file` and, for those with too many cells, `_rejected`: the record as it stands."""
    layouts, files = _layouts(spark, path, sep, encoding)
    parts = [_read(spark, names, columns, mark, code, whole, header) for (code, whole, mark, columns, header), names in layouts.items()]
    if not parts:
        return spark.createDataFrame([], f"`{rid}` long, _file string, _rejected string")
    # Where the records of each split of a file begin in the file: counted once, one row per split.
    splits = reduce(DataFrame.unionByName, (p.groupBy("_file", "_start").agg(F.count("*").alias("n"), F.min("_at").alias("first")) for p in parts))
    before = F.sum("n").over(Window.partitionBy("_file").orderBy("_start")) - F.col("n")
    ranks = spark.createDataFrame(list(enumerate(files)), "rank long, name string")
    begins = splits.join(ranks, F.url_decode(F.replace("_file", F.lit("+"), F.lit("%2B"))) == F.col("name")).select("_file", "_start", (F.shiftleft("rank", RECORD_BITS) + before - F.col("first")).alias("_base"))
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).join(begins, ["_file", "_start"])
    return together.withColumn(rid, F.col("_base") + F.col("_at")).drop("_base", "_at", "_start")


def read_raw(spark, path, fmt="csv", rid="_rid", sep=None, encoding=None):
    """SRC-01, SRC-02: every column text, only empty cells null, a row id added.

    Each file is read by its own header, delimiter and encoding, decided on all its lines, and its columns are matched by name; columns that a file lacks are
    null. Files without a header have columns col_0, col_1 ... Only files with line ends inside quotes are read without being split. Rows with
    too few cells are kept and end in nulls; rows with too many are left out here and listed by ``read_rejected``. The row id is the rank of
    the file by name and the number of the record in it, whatever the splits. The text is read three times: for these facts, to count records per split, and for the rows.
    """
    if fmt == "parquet":
        df = spark.read.parquet(path)
        return df.select(F.monotonically_increasing_id().alias(rid), *[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
    found = _records(spark, path, rid, sep, encoding)
    return found.filter("_rejected IS NULL").select(rid, *[F.col(f"`{c}`") for c in found.columns if c not in (rid, "_file", "_rejected")])


def read_rejected(spark, path, rid="_rid", sep=None, encoding=None):
    """SRC-01: the records that ``read_raw`` leaves out, having more cells than their file has columns: row id, file and line."""
    return _records(spark, path, rid, sep, encoding).filter("_rejected IS NOT NULL").select(rid, F.col("_file").alias("file"), F.col("_rejected").alias("line"))


def _unique(names):
    """Header names; an empty or repeated one (Spark's names do not differ by case) gets its position."""
    low = [n.lower() for n in names]
    return [n if n and low.index(low[i]) == i else f"{n or '_c'}{i}" for i, n in enumerate(names)]


def _read(spark, files, columns, sep, encoding, whole, header):
    raw = "_malformed_line"
    schema = StructType([StructField(c, StringType()) for c in (*columns, raw)])
    # Cells of columns that are not asked for must be counted too.
    reader = (spark.read.schema(schema).option("sep", sep).option("encoding", encoding).option("nullValue", "").option("escape", '"').option("header", header).option("enforceSchema", True)
              .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", raw).option("multiLine", whole).option("columnPruning", False))
    bare = F.regexp_replace(raw, '"[^"]*"', "")
    cells = F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit(""))) + 1
    # Always true: Spark refuses to read the malformed lines alone.
    beside = F.length(F.concat_ws("", F.col(f"`{columns[0]}`"))) >= 0
    return reader.csv(files).select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"),
                                    *[F.col(f"`{c}`") for c in columns], F.when((cells > len(columns)) & beside, F.col(raw)).alias("_rejected"))


def spread(df, key):
    """Give every core a share of a source that arrives in fewer splits than there are cores (one small file).

    Rule-heavy jobs are bound by computation, so a small shuffle by row id pays off. A source with enough splits, as any
    large one has, is returned untouched. Only for plain scans: the number of splits is read from the plan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, F.col(key))


def numeric_shares(df, columns):
    """Per column: non-null cells, cells that are numbers, cells that are boolean words. One aggregate."""
    t = lambda c: F.trim(F.col(f"`{c}`").cast("string"))
    row = df.agg(*[x for c in columns for x in (F.count(F.nullif(t(c), F.lit(""))), F.count(t(c).try_cast("double")), F.count_if(F.lower(t(c)).isin(*BOOLEAN_WORDS)))]).first()
    return {c: tuple(row[3 * i:3 * i + 3]) for i, c in enumerate(columns)}


def promote_types(df, rid="_rid", least=0.9):
    """SRC-03: text columns that are at least 90 % numbers become double; columns of boolean words stay text."""
    texts = [c for c, t in df.dtypes if t == "string" and c != rid]
    shares = numeric_shares(df, texts) if texts else {}
    numbers = [c for c in texts if shares[c][0] and shares[c][2] <= 0.5 * shares[c][0] and shares[c][1] >= least * shares[c][0]]
    return df.select(*[F.trim(F.col(f"`{c}`")).try_cast("double").alias(c) if c in numbers else F.col(f"`{c}`") for c in df.columns])


def column_kind(df, columns, least=0.8):
    """SRC-04: empty, boolean, numeric or string per column."""
    shares = numeric_shares(df, columns)
    def kind(filled, numbers, booleans):
        if not filled:
            return "empty"
        return "boolean" if booleans > 0.5 * filled else "numeric" if numbers >= least * filled else "string"
    return df.sparkSession.createDataFrame([(c, kind(*shares[c])) for c in columns], "column string, kind string")


def coerce(v, to):
    """SRC-05: null, str, float, int or bool from one text cell; currency marks, percent and separators are ignored in numbers."""
    t = F.nullif(F.trim(v.cast("string")), F.lit(""))
    number = F.regexp_replace(t, r"[,$£€¥%() ]", "").try_cast("double")
    finite = F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)
    if to == "float":
        return finite
    if to == "int":
        return F.when(finite == F.floor(finite), finite.cast("long"))
    if to == "bool":
        low = F.lower(t)
        return F.when(low.isin("true", "yes", "y", "1", "t", "on"), True).when(low.isin("false", "no", "n", "0", "f", "off"), False)
    return t


def coerce_columns(df, spec):
    """SRC-05 over a table: {column: 'str' | 'float' | 'int' | 'bool'}."""
    return df.select(*[coerce(F.col(f"`{c}`"), spec[c]).alias(c) if c in spec else F.col(f"`{c}`") for c in df.columns])
