"""Operator 10: URL filters by a trie over reversed host labels and path segments.

The rules become one trie: reversed host labels lead to a host, from which path
segments lead on; the last, possibly partial, segment of a rule is compared as
a prefix. The walk collects each rule on its way, and the longest rule wins.
The trie is broadcast (in the task closure) only up to `max_rules` rules; larger
rule tables are joined instead, on (host, directory) keys of bounded number per
url.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelframe.llm.common import cut, join_by_share

#: The rules of the registered query, longest match first to win.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(UPPER, LOWER)
SCHEMA = "page_id long, host string, path string, rule string, verdict string"


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path) of a url; both empty if it is null or has no '://'."""
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((k for k in (rest.find("/"), rest.find("?"), rest.find("#")) if k >= 0), default=len(rest))
    stop = min((k for k in (rest.find("?", end), rest.find("#", end)) if k >= 0), default=len(rest))
    return rest[:end].translate(_FOLD), rest[end:stop]


@dataclass
class Node:
    children: dict[str, Node] = field(default_factory=dict)
    paths: Node | None = None
    partial: list[tuple[str, tuple[int, int], str, str]] = field(default_factory=list)


def build(rules: list[tuple[str, str, str]]) -> Node:
    """The trie of (verdict, host, path) rules; where equal hosts and paths have both verdicts, block counts."""
    root, ruled = Node(), {}
    for verdict, host, path in rules:
        ruled[host, path] = max(verdict, ruled.get((host, path), ""))
    for (host, path), verdict in ruled.items():
        node = root
        for label in reversed(host.split(".")):
            node = node.children.setdefault(label, Node())
        node.paths = node.paths or Node()
        node = node.paths
        *full, last = path.split("/")
        for segment in full:
            node = node.children.setdefault(segment, Node())
        node.partial.append((last, (len(host) + len(path), len(host)), host + path, verdict))
    return root


def longest(root: Node, host: str, path: str) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits; of equally long ones, that of the longer host."""
    best, node = None, root
    segments = path.split("/")
    for label in reversed(host.split(".")):
        node = node.children.get(label)
        if node is None:
            break
        below, k = node.paths, 0
        while below is not None:
            for last, weight, rule, verdict in below.partial:
                if segments[k].startswith(last) and (best is None or weight > best[0]):
                    best = (weight, rule, verdict)
            below, k = (below.children.get(segments[k]), k + 1) if k + 1 < len(segments) else (None, k)
    return best and best[1:]


def default_verdict(host: str) -> str:
    """Without a rule: a url with a host is allowed, one without is blocked."""
    return "allow" if host else "block"


def judge(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """page_id, host, path, rule, verdict of each row, by a broadcast trie.

    Null urls and urls without '://' have an empty host and path, no rule and
    the verdict block. A rule fits its host and all subdomains when the path
    starts with the rule's; the longest (host and path together) wins. Repeated
    rows each give a row; an empty table gives none.
    """
    root = build(rules)

    def run(batches):
        for batch in batches:
            out = []
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                rule, verdict = longest(root, host, path) or (None, default_verdict(host))
                out.append((host, path, rule, verdict))
            columns = [pa.array(c, pa.string()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.string())] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["page_id", "host", "path", "rule", "verdict"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).mapInArrow(run, SCHEMA)


def judge_by_join(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """As judge(), for rule tables (verdict, host, path) of any size; rules with a null in them are left out.

    A url gives one key for each suffix of its host and directory of its path;
    one row a key holds its rules, and keys that a large share of the urls have
    (a whole top-level domain's) are joined by broadcast. Only one rule per url
    is left by an aggregate that combines before its shuffle.
    """
    parts = F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)([^?#]*)", 1), F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)([^?#]*)", 2)
    base = pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url")).select(
        F.col("page_id").cast("long").alias("page_id"), F.translate(parts[0], UPPER, LOWER).alias("host"), parts[1].alias("path")
    )
    base = cut(base.withColumn("row", F.monotonically_increasing_id()))
    labels, segments = F.split("host", r"\.", -1), F.split("path", "/", -1)
    keys = base.withColumn("k_host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))))
    keys = keys.withColumn("k_dir", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(segments) - 1)), lambda k: F.array_join(F.slice(segments, 1, k), "/"))))
    keys = keys.select("row", "path", "k_host", "k_dir")
    own = rules.dropna(subset=["verdict", "host", "path"]).groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    own = own.groupBy(F.col("host").alias("r_host"), F.regexp_replace("path", "/?[^/]*$", "").alias("r_dir")).agg(F.collect_list(F.struct("path", "verdict")).alias("rules"))
    counts = keys.groupBy(F.col("k_host").alias("n_host"), F.col("k_dir").alias("n_dir")).agg(F.count(F.lit(1)).alias("n"))
    right = own.join(counts, (F.col("r_host") == F.col("n_host")) & (F.col("r_dir") == F.col("n_dir"))).drop("n_host", "n_dir")
    hit = join_by_share(keys, cut(right), (F.col("k_host") == F.col("r_host")) & (F.col("k_dir") == F.col("r_dir")), "n")
    weighed = F.transform(
        F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"])),
        lambda r: F.struct((F.length("r_host") + F.length(r["path"])).alias("size"), F.length("r_host").alias("host_size"), F.concat("r_host", r["path"]).alias("rule"), r["verdict"].alias("verdict")),
    )
    best = hit.groupBy(F.col("row").alias("b_row")).agg(F.max(F.array_max(weighed)).alias("b"))
    return base.join(best, F.col("row") == F.col("b_row"), "left").select(
        "page_id", "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.verdict", F.when(F.col("host") != "", "allow").otherwise("block")).alias("verdict")
    )


def verdicts(pages: DataFrame, rules: DataFrame, max_rules: int = 200_000) -> DataFrame:
    """judge() if rules has at most max_rules rows (about 50 MB as a trie), else judge_by_join(); both give the same rows.

    Rules with a null in them are left out; where equal hosts and paths have
    both verdicts, block counts.
    """
    few = rules.select("verdict", "host", "path").dropna().limit(max_rules + 1).collect()
    return judge(pages, [tuple(r) for r in few]) if len(few) <= max_rules else judge_by_join(pages, rules)
