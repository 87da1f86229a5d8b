"""Source files that nobody wrote by hand: tool output, squeezed files, third-party copies, data saved as code.

A random forest judges each readable file: how well it compresses, how its tokens are spread, how long identifiers and lines are,
how much of it is comment, literal or code, and whether its path is one that tools and package managers use. What it learns from
are header notices, which are cut out of the text before the features are taken, so that it has to find what such files have
in common: tools' notices, and those of third parties below known paths; elsewhere third-party code has nothing but its
notice. Files without a notice are examples of hand-written ones, those below known paths of nothing. Data bears no notices:
there, files of which next to nothing is left outside literals and comments are the examples, and those of which little is
left are none.

Beside the forest's verdict stand only: the notice itself, as third-party code looks like any other; the same text as that of a file
with a sign; and a file too big to be read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import stage

#: Labelled rows the forest is fitted on, about, and its size.
FIT_ROWS = 20_000
FIT_PARTS = 8
TREES = 32
DEPTH = 6
#: Share of the features each node chooses from: enough for a path to be weighed in nearly every tree.
FEATURE_SHARE = "0.5"
#: Up to this share of identifier characters outside comments and literals a file is an example of data, from CLEAR_SHARE on of none.
DATA_SHARE, CLEAR_SHARE = 0.1, 0.3
DATA_LEAST_CHARS = 200
#: A file without a notice that a first forest gives this probability is no example of a hand-written one.
DOUBT = 0.25
#: One of so many labelled rows is held out by evaluation().
HELD_OUT = 5
#: The indexer reads no file above this size.
READ_LIMIT = 1 << 20
BLOCK = 4096

# Directories and file names that package managers, bundlers and generators use.
_PATH = re.compile(
    r"(?:^|/)(?:vendor|vendored|third_party|third-party|thirdparty|3rdparty|node_modules|bower_components|extern|external|deps|dist|__generated__|site-packages)/"
    r"|(?:^|/)target/(?:debug|release)/"
    r"|[.-](?:min|bundle|chunk)\.\w+$"
    r"|\.(?:pb|g|gen|generated)\.\w+$"
    r"|(?:_pb2|_pb2_grpc|_generated|\.designer)\.\w+$",
    re.I,
)

# What tools write on top of their output, and what third-party sources carry.
_TOOL = re.compile(
    r"@generated\b|<auto-?generated|\bauto(?:matically)?[- ]?generated\b|\bgenerated (?:file|code|by|from|output)\b|\bcode generated\b"
    r"|\bmachine[- ](?:made|generated|written)\b|\bdo not (?:edit|modify)\b(?:\s*[.!*/:-]|\s+(?:by hand|manually|directly|this file)|\s*$)|\bregenerate (?:with|by|using)\b",
    re.I | re.M,
)
_BANNER = re.compile(r"^/\*!.*\bv?\d+\.\d+", re.S)
_THIRD = re.compile(
    r"\bthird[- ]party (?:code|source|software|library|file)|\bvendored\b.{0,20}\bfrom\b|\b(?:imported|verbatim) copy of\b|\bredistribution and use in source\b",
    re.I | re.S,
)

_IDENTIFIER = re.compile(r"[A-Za-z_$][\w$]*")
_NUMBER = re.compile(r"(?<![\w$])\d[\w.]*")
_BRACED = re.compile(r'(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<literal>\bb?r(?P<h>#*)".*?"(?P=h)|b?"(?:\\.|[^"\\])*"|`(?:\\.|[^`\\])*`|\'(?:\\.|[^\'\\\n])(?:[^\'\\\n]*\')?)', re.S)
_SCRIPT = re.compile(r"(?P<comment>\#[^\n]*|\"\"\"(?:\\.|[^\\])*?\"\"\"|'''(?:\\.|[^\\])*?''')|(?P<literal>\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\\n])*')", re.S)

FEATURES = ["ratio", "entropy", "distinct", "identifier_mean", "identifier_short", "comment_share", "line_mean", "line_longest", "digit_share", "space_share", "mark_share", "code_share", "literal_share", "known_path"]


def opening(text: str) -> int:
    """The length of the comments that open a text, with the empty lines between them."""
    end = 0
    m = re.compile(r"(?:\s*(?://[^\n]*|\#(?!!?\[)[^\n]*|/\*.*?(?:\*/|\Z)))+", re.S).match(text)
    if m:
        end = m.end()
    return end


def notices(text: str) -> tuple[bool, bool, str]:
    """(a tool's notice, a third-party notice, the text without the opening comment's lines that are one)."""
    end = opening(text)
    head = text[:end]
    banner = bool(_BANNER.match(head.lstrip()))
    tool, third = banner or bool(_TOOL.search(head)), bool(_THIRD.search(head))
    if tool or third:
        kept = "" if banner else "\n".join(x for x in head.split("\n") if not (_TOOL.search(x) or _THIRD.search(x)))
        return tool, third, kept + text[end:]
    return False, False, text


def features(path: str, text: str) -> tuple[list[float], int]:
    """The forest's features of a text, and the characters that are no comment."""
    raw = text.encode("utf-8", "surrogatepass")
    n = max(1, len(text))
    squeezed = sum(len(zlib.compress(raw[i : i + BLOCK], 1)) for i in range(0, len(raw), BLOCK))
    words = _IDENTIFIER.findall(text)
    counts = Counter(words)
    total = max(1, len(words))
    entropy = math.log2(total) - sum(c * math.log2(c) for c in counts.values()) / total
    lengths = np.fromiter(map(len, words), np.int32, len(words))
    comment = literal = 0
    outside, last = [], 0
    for m in (_SCRIPT if path.endswith(".py") else _BRACED).finditer(text):
        if m["comment"] is not None:
            comment += m.end() - m.start()
        else:
            literal += m.end() - m.start()
        outside.append(text[last : m.start()])
        last = m.end()
    outside.append(text[last:])
    bare = _NUMBER.sub(" ", " ".join(outside))
    named = sum(map(len, _IDENTIFIER.findall(bare)))
    code = np.frombuffer(raw, np.uint8)
    digits = int(((code >= 48) & (code <= 57)).sum())
    spaces = int((code <= 32).sum())
    letters = int((((code | 32) >= 97) & ((code | 32) <= 122)).sum())
    lines = text.split("\n")
    rest = max(1, len(text) - comment)
    return (
        [
            squeezed / max(1, len(raw)),
            entropy / max(1.0, math.log2(total + 1)),
            len(counts) / total,
            float(lengths.mean()) if len(lengths) else 0.0,
            float((lengths <= 2).mean()) if len(lengths) else 0.0,
            comment / n,
            math.log1p(n / len(lines)),
            math.log1p(max(map(len, lines))),
            digits / max(1, len(raw)),
            spaces / max(1, len(raw)),
            max(0, len(raw) - digits - spaces - letters) / max(1, len(raw)),
            named / rest,
            literal / rest,
            float(bool(_PATH.search(path))),
        ],
        rest,
    )


_SEEN = "file_id string, same binary, tool boolean, third boolean, chars int, " + ", ".join(f"{f} double" for f in FEATURES)


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split(" ")[0] for x in _SEEN.split(", ")]
    for b in batches:
        for s in range(0, b.num_rows, 200):
            part = b.slice(s, 200)
            same, tool, third, chars, seen = [], [], [], [], []
            for path, text in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                by_tool, by_others, rest = notices(text)
                f, n = features(path or "", rest)
                same.append(xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass")))
                tool.append(by_tool)
                third.append(by_others)
                chars.append(n)
                seen.append(f)
            columns = [part.column(0), pa.array(same, pa.binary()), pa.array(tool), pa.array(third), pa.array(chars, pa.int32())]
            columns += [pa.array(c, pa.float64()) for c in np.asarray(seen, np.float64).T]
            yield pa.RecordBatch.from_arrays(columns, names)


def measured(sources: DataFrame) -> DataFrame:
    """Text hash, notices, and features of each readable file (file_id, path, source), once: of several texts that with the smallest hash."""
    seen = sources.select("file_id", "path", "source").where("file_id is not null and source is not null").mapInArrow(_judged, _SEEN)
    rest = [c for c in seen.columns if c not in ("file_id", "same")]
    return seen.groupBy("file_id").agg(F.min(F.struct("same", *rest)).alias("s")).select("file_id", "s.*")


def labelled(seen: DataFrame) -> DataFrame:
    """The rows of measured() that are examples, with their label: 1 for a tool's notice, a third party's below a known path, and
    what is clearly data; 0 for what has no notice, no known path, and is clearly no data."""
    known = F.col("known_path") == 1.0
    data, unclear = (F.col("chars") >= DATA_LEAST_CHARS) & (F.col("code_share") < DATA_SHARE), F.col("code_share") < CLEAR_SHARE
    label = F.when(F.col("tool") | (F.col("third") & known) | data, 1.0).when(~(F.col("third") | known | unclear), 0.0)
    return seen.withColumn("label", label).where("label is not null")


def fit(examples: DataFrame):
    """A random forest over (FEATURES, label), both classes weighing the same; None if one of them has no rows.

    The rows are a bounded sample: about FIT_ROWS of them, those with the smallest hash of their id, in an order of their own, so that
    the forest is the same however the table is split. Files without a notice need not be hand-written: those that a first forest
    gives DOUBT or more are no examples for the one that counts."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    counts = {r.label: r.n for r in examples.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    share = min(1.0, FIT_ROWS / sum(counts.values()))
    sample = examples.where((F.xxhash64("file_id", F.lit(3)) / float(1 << 63)) <= 2 * share - 1) if share < 1 else examples
    sample = sample.withColumn("weight", F.when(F.col("label") == 1.0, counts[0.0] / counts[1.0]).otherwise(1.0))
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample).select("file_id", "features", "label", "weight")
    rows = rows.repartition(FIT_PARTS, "file_id").sortWithinPartitions("file_id")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=3, weightCol="weight", seed=7, subsamplingRate=0.8, featureSubsetStrategy=FEATURE_SHARE)
    sure = forest.fit(rows).transform(rows).where((F.col("label") == 1.0) | (vector_to_array("probability")[1] < DOUBT))
    return forest.fit(sure.select("features", "label", "weight"))


def judged(model, seen: DataFrame) -> DataFrame:
    """file_id and forest, the model's verdict, of rows of measured(); without a model it says nothing."""
    from pyspark.ml.feature import VectorAssembler

    if model is None:
        return seen.select("file_id", F.lit(False).alias("forest"))
    return model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(seen)).select("file_id", (F.col("prediction") == 1.0).alias("forest"))


def evaluation(sources: DataFrame) -> DataFrame:
    """kind (tool, third, data, hand), forest, n: how a forest fitted without one in HELD_OUT labelled rows judges those, by what they are."""
    rows = labelled(stage(measured(sources), "features"))
    out = F.pmod(F.xxhash64("file_id", F.lit(5)), F.lit(HELD_OUT)) == 0
    kind = F.when(F.col("tool"), "tool").when(F.col("third"), "third").when(F.col("label") == 1.0, "data").otherwise("hand")
    held = rows.where(out)
    return held.select("file_id", kind.alias("kind")).join(judged(fit(rows.where(~out)), held), "file_id").groupBy("kind", "forest").agg(F.count("*").alias("n"))


def verdicts(files: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, by_notice, by_forest, by_copy, by_size), one row per file of code_file that has any of them.

    by_size: the source is null, or there is none and size_bytes is above READ_LIMIT. by_copy: its text is that of a file with
    another sign, and it has none of its own. language is not used, it is null or misspelt too often. Files with a null id are left
    out; repeated ids count once; an empty file is judged by the forest as any other; an empty table gives no rows; without examples
    of both classes the forest says nothing.
    """
    seen = stage(measured(sources), "features")
    forest = judged(fit(labelled(seen)), seen)
    known = files.where("id is not null").groupBy("id").agg(F.max("size_bytes").alias("size_bytes"))
    unread = sources.where("file_id is not null").groupBy(F.col("file_id").alias("id")).agg(F.max(F.col("source").isNotNull()).alias("read"))
    by_size = F.when(F.col("read").isNull(), F.col("size_bytes") > READ_LIMIT).otherwise(~F.col("read"))
    text = seen.select(F.col("file_id").alias("id"), "same", (F.col("tool") | F.col("third")).alias("notice"))
    own = known.join(unread, "id", "left").select("id", F.coalesce(by_size, F.lit(False)).alias("by_size")).join(text, "id", "left").join(forest.withColumnRenamed("file_id", "id"), "id", "left")
    own = stage(own.select("id", "same", F.coalesce("notice", F.lit(False)).alias("by_notice"), F.coalesce("forest", F.lit(False)).alias("by_forest"), "by_size"), "signs")
    sign = F.col("by_notice") | F.col("by_forest") | F.col("by_size")
    copied = own.where("same is not null").groupBy("same").agg(F.max(sign).alias("any"), F.count("*").alias("n")).where("any and n > 1").select("same", F.lit(True).alias("copy"))
    out = own.join(copied, "same", "left").select("id", "by_notice", "by_forest", (~sign & F.coalesce("copy", F.lit(False))).alias("by_copy"), "by_size")
    return out.where("by_notice or by_forest or by_copy or by_size")


def found(files: DataFrame, sources: DataFrame) -> DataFrame:
    """id of each file that is not hand-written source of this project."""
    return verdicts(files, sources).select("id")
