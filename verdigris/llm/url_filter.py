"""URL filtering by a trie of host labels, from the top label down, and path segments."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Rules whose trie takes up to about so many bytes are sent to every executor, where each worker builds the trie once;
#: beyond it the rules are joined by a shuffle.
BROADCAST_BYTES = 64 << 20
#: Bytes of a node with its entry above it, roughly.
_NODE_BYTES = 500
_tries: dict[str, "Node"] = {}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """host is a lower-case host without a leading dot, path is empty or begins with a slash, verdict is allow or block."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def _rank(rule: Rule) -> tuple[int, int, bool]:
    """The longest rule wins; of equally long ones that with the longer host, then a block."""
    return len(rule.text), len(rule.host), rule.verdict == "block"


@dataclass
class Node:
    """below: child by whole host label or whole path segment. paths: where paths begin, under a host. ends: the rules
    whose last, possibly partial, segment starts here, by that segment."""

    below: dict[str, "Node"] = field(default_factory=dict)
    paths: "Node | None" = None
    ends: dict[str, Rule] = field(default_factory=dict)
    lengths: list[int] = field(default_factory=list)


def build_trie(rules: list[Rule]) -> Node:
    root = Node()
    for rule in rules:
        node = root
        for label in reversed(rule.host.split(".")):
            node = node.below.setdefault(label, Node())
        node.paths = node.paths or Node()
        node = node.paths
        *whole, last = rule.path.split("/")
        for segment in whole:
            node = node.below.setdefault(segment, Node())
        if last not in node.ends or _rank(rule) > _rank(node.ends[last]):
            node.ends[last] = rule
        node.lengths = sorted({len(end) for end in node.ends})
    return root


def trie_bytes(rules: list[Rule]) -> int:
    """About how much memory the rules' trie takes at most: a node for each label and segment, and the texts."""
    return sum(_NODE_BYTES * (2 + r.host.count(".") + r.path.count("/")) + 4 * len(r.text) for r in rules)


def _shared_trie(shared: Broadcast) -> Node:
    """The trie of broadcast rules, built once in a worker process."""
    token, rules = shared.value
    if token not in _tries:
        _tries.clear()
        _tries[token] = build_trie([Rule(*r) for r in rules])
    return _tries[token]


def longest_match(root: Node, host: str, path: str) -> Rule | None:
    """The winning rule among those whose host is ``host`` or a parent domain of it and whose path begins ``path``."""
    best: Rule | None = None
    node = root
    segments = path.split("/")
    for label in reversed(host.split(".")):
        node = node.below.get(label)  # type: ignore[assignment]
        if node is None:
            break
        at = node.paths
        for segment in segments:
            if at is None:
                break
            for n in at.lengths:
                rule = at.ends.get(segment[:n]) if n <= len(segment) else None
                if rule is not None and (best is None or _rank(rule) > _rank(best)):
                    best = rule
            at = at.below.get(segment)
    return best


def host_and_path(urls: DataFrame, url_col: str) -> DataFrame:
    """Add ``host`` (after the first ``://`` up to a slash, question mark, hash or the end; A-Z lower-cased) and ``path``
    (from there up to a question mark, hash or the end). A null url, or one without ``://``, has both empty. Columns of
    these names are replaced."""
    url = F.col(url_col).cast("string")
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return urls.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))})


def judge(urls: DataFrame, rules: list[Rule], url_col: str = "url", default: str = "allow", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Add host, path, ``rule`` (host and path of the longest matching rule, else null) and ``verdict`` (the rule's, else
    ``default``) to every row; columns of these names are replaced, all others stay.

    Null, empty and malformed urls match nothing. Without rules every verdict is the default. Of rules with the same host
    and path a block wins. An empty table gives an empty result.
    """
    bad = [r for r in rules if r.verdict not in ("allow", "block") or not r.host]
    if bad:
        raise ValueError(f"rules need a host and a verdict of allow or block: {bad[:3]}")
    split = host_and_path(urls.drop("rule", "verdict"), url_col)
    if trie_bytes(rules) > broadcast_bytes:
        return _judge_by_join(split, rules, default)
    shared = urls.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, [(r.host, r.path, r.verdict) for r in rules]))
    names = split.columns
    host_at, path_at = names.index("host"), names.index("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = _shared_trie(shared)
        for batch in batches:
            found = [longest_match(root, h, p) for h, p in zip(batch.column(host_at).to_pylist(), batch.column(path_at).to_pylist(), strict=True)]
            rule = pa.array([r.text if r else None for r in found], pa.string())
            verdict = pa.array([r.verdict if r else default for r in found], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, rule, verdict], [*names, "rule", "verdict"])

    schema = StructType(split.schema.fields + [StructField("rule", StringType()), StructField("verdict", StringType())])
    return split.mapInArrow(run, schema)


def _judge_by_join(split: DataFrame, rules: list[Rule], default: str) -> DataFrame:
    """The same without a broadcast: each distinct (host, path) is joined at each of its anchors, which are a parent domain
    and a run of whole path segments, with the rules that end below that anchor."""
    spark = split.sparkSession
    rows = [(r.host + "/" * bool(r.path) + "/".join(r.path.split("/")[1:-1]) + ("/" if r.path.count("/") > 1 else ""), r.path, r.text, r.verdict, len(r.host)) for r in rules]
    table = spark.createDataFrame(rows, "anchor string, rule_path string, rule string, verdict string, host_length int")
    hosted = split.where("host <> ''")
    pairs = hosted.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    parts = F.split("path", "/")
    whole = F.when(F.length("path") > 0, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.concat_ws("/", F.slice(parts, 1, i)), F.lit("/")))).otherwise(F.array().cast("array<string>"))
    exploded = pairs.withColumn("domain", F.explode(domains)).withColumn("prefix", F.explode(F.concat(F.array(F.lit("")), whole)))
    hits = exploded.withColumn("anchor", F.concat("domain", "prefix")).join(table, "anchor").where(F.col("path").startswith(F.col("rule_path")))
    order = F.struct(F.length("rule"), F.col("host_length"), (F.col("verdict") == "block").cast("int"))
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), order).alias("best"))
    out = hosted.join(best, ["host", "path"], "left").select(*split.columns, F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    return out.union(split.where("host = ''").select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")))  # no rule is without a host
