"""URL filter: host and path rules, indexed by their rarest literal token.

Each rule is a host and a path prefix.  Its literal tokens are its host labels
and path segments; the one that occurs in the fewest rules indexes it.  The
tokens of a URL fetch candidate rules from that index, and only these run their
regular expression.  The longest rule that fits gives the verdict.

Up to MAX_RULES the index is a constant inside the projection, an array of
buckets by the token's checksum, so a look-up costs the same for any number of
rules: no join, no shuffle, one pass over the url column.  A longer list is a
table: the tokens of each distinct host and path are joined with it, and the
verdicts with the rows.
"""

from __future__ import annotations

import json
import re
import string
import zlib
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import join_groups

#: Rules up to which the index is a constant in the plan.
MAX_RULES = 5000


@dataclass(frozen=True)
class Rule:
    verdict: str  # "allow" or "block"
    pattern: str  # host and path prefix, like "example.com/en/"

    def host(self) -> str:
        return self.pattern.partition("/")[0]

    def path(self) -> str:
        return "/" + self.pattern.partition("/")[2]

    def tokens(self) -> list[str]:
        return [f"h:{x}" for x in self.host().split(".") if x] + [f"p:{x}" for x in self.path().split("/")[1:-1] if x]

    def regex(self) -> str:
        """Over host + newline + path: the host or a subdomain of it, then the path prefix; a host holds no '/'."""
        return rf"^(?:[^/]*\.)?{_quote(self.host())}\n{_quote(self.path())}"


def _quote(text: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}\-])", r"\\\1", text)


def _index(rules: list[Rule]) -> dict[str, list[Rule]]:
    seen = Counter(t for r in rules for t in set(r.tokens()))
    index: dict[str, list[Rule]] = {}
    for rule in rules:
        tokens = rule.tokens()
        key = min(tokens, key=lambda t: (seen[t], t)) if tokens else ""
        index.setdefault(key, []).append(rule)
    return index


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end; A-Z lower-cased; empty without '://'."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    low = F.translate(host, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.instr(url, "://") > 0, low).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(F.instr(url, "://") > 0, path).otherwise(F.lit(""))


def _tokens() -> Column:
    labels = F.transform(F.split("host", r"\."), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.split("path", "/"), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(F.array(F.lit("")), labels, segments))


def _subject() -> Column:
    return F.concat(F.col("host"), F.lit("\n"), F.col("path"))


def _by_buckets(rules: list[Rule]) -> Column:
    """The best fitting rule of the row's host and path, from an index that is a constant: buckets of (token, rule) by the token's checksum."""
    index = _index(rules)
    n = 1 << (2 * len(index)).bit_length()
    buckets: list[list[dict]] = [[] for _ in range(n)]
    for token, found in sorted(index.items()):
        buckets[zlib.crc32(token.encode()) % n] += [
            {"token": token, "size": len(r.pattern), "block": int(r.verdict == "block"), "pattern": r.pattern, "verdict": r.verdict, "regex": r.regex()} for r in found
        ]
    kind = "array<array<struct<token:string,size:int,block:int,pattern:string,verdict:string,regex:string>>>"
    table = F.from_json(F.lit(json.dumps(buckets)), kind)
    bucket = lambda t: F.element_at(table, (F.crc32(t.cast("binary")) % n + 1).cast("int"))
    candidates = F.flatten(F.transform(_tokens(), lambda t: F.filter(bucket(t), lambda c: c["token"] == t)))
    fits = F.filter(candidates, lambda c: F.rlike(_subject(), c["regex"]))
    best = F.array_max(F.transform(fits, lambda c: F.struct(c["size"], c["block"], c["pattern"], c["verdict"])))
    return F.when(F.col("host") != "", best)


def _by_join(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """rows with `best`, from an index that is a table.  Distinct hosts and paths are looked up once, so a hot url is one row there."""
    spark = rows.sparkSession
    flat = [(token, len(r.pattern), int(r.verdict == "block"), r.pattern, r.verdict, r.regex()) for token, found in _index(rules).items() for r in found]
    index = spark.createDataFrame(flat, "token string, size int, block int, pattern string, verdict string, regex string")
    asked = rows.filter("host != ''").select("host", "path").distinct()
    candidates = asked.withColumn("token", F.explode(_tokens())).join(index, "token").filter(F.rlike(_subject(), F.col("regex")))
    best = candidates.groupBy("host", "path").agg(F.max(F.struct("size", "block", "pattern", "verdict")).alias("best"))
    return join_groups(rows, best, ["host", "path"])


def filter_urls(df: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """df with host, path, rule and verdict.

    rule: pattern of the longest rule that fits (ties: block before allow, then
    by pattern), else null, and then verdict is `default`.  A null url or one
    without '://' has an empty host and path and fits no rule.  A path segment
    counts as a token only where the rule's prefix holds it whole.  Repeated
    rows stay; columns of df with the names of the new ones are replaced.  An
    empty rule list gives the default everywhere; a list of any length is taken.
    """
    rules = list(dict.fromkeys(rules))
    new = ("host", "path", "rule", "verdict")
    kept = F.struct(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in new]).alias("row")
    out = df.select(kept, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    if not rules:
        out = out.withColumn("best", F.lit(None).cast("struct<size:int,block:int,pattern:string,verdict:string>"))
    elif len(rules) <= MAX_RULES:
        out = out.withColumn("best", _by_buckets(rules))
    else:
        out = _by_join(out, rules)
    return out.select("row.*", "host", "path", F.col("best.pattern").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"))


#: Fixed by the contract of the query.
RULES = [
    Rule("allow", "com/"),
    Rule("block", "example.com/en/"),
    Rule("allow", "www.example.com/en/"),
    Rule("block", "net/es/"),
    Rule("block", "net/fr/"),
]
