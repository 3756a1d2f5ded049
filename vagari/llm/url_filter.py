"""URL filters: pattern rules indexed by their rarest literal token. [native]

A rule is a regular expression over host + path with the literal tokens that
any match contains. The rule is filed under the one of these that the fewest
urls have. A url's tokens fetch rules from this index and only those run.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from zlib import crc32

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, free

TOKEN_BREAK = r"[^A-Za-z0-9]+"
BUCKETS = 64


@dataclass(frozen=True)
class Rule:
    """name: what the result shows; pattern over host + path; tokens: literals of each match; rank: the highest wins; 0 or less: not a listed rule, only the verdict counts."""

    name: str
    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    rank: int


def host_rule(text: str, verdict: str) -> Rule:
    """'example.com/en/': that host and its subdomains, paths that start with /en/. Longer rules win."""
    host, slash, path = text.partition("/")
    path = slash + path
    quote = lambda s: "".join(c if c.isalnum() else "\\" + c if ord(c) < 128 else c for c in s)
    # The last path part may go on in the url ("/en" also fits "/english"): it is no whole token.
    literals = re.findall("[A-Za-z0-9]+", "/".join([host, *path.split("/")[1:-1]]))
    return Rule(text, f"(?s)^([^/]*\\.)?{quote(host)}{quote(path)}.*", tuple(dict.fromkeys(literals)), verdict, len(text))


def word_rule(*words: str, verdict: str = "block") -> Rule:
    """A host that has these words next to each other as whole parts between dots and hyphens."""
    return Rule("-".join(words), "(?s)^([^/]*[.-])?" + "[.-]".join(words) + "([.-][^/]*)?(/.*)?$", words, verdict, 0)


def list_rule(line: str) -> Rule:
    """A line of a filter list: '||host^' (that host and its subdomains), '|' at an end (the place begins or ends there), '*' (anything), '^' (a separator or the end), '@@' before it all: allow. Allowing lines win over blocking ones, longer lines over shorter."""
    allow = line.startswith("@@")
    body = line.removeprefix("@@")
    start = "^([^/]*\\.)?" if body.startswith("||") else "^" if body.startswith("|") else ""
    body = body.lstrip("|")
    end = "$" if body.endswith("|") else ""
    body = body.rstrip("|")
    special = {"*": ".*", "^": "([^A-Za-z0-9_.%-]|$)"}
    pattern = "".join(special.get(c, c if c.isalnum() else "\\" + c if ord(c) < 128 else c) for c in body)
    # A literal beside * or at an open end may go on in the url: only whole tokens are filed.
    open_left, open_right = not start, not end
    parts = re.split("[^A-Za-z0-9]", body)
    marks = ["" if open_left else "|", *re.findall("[^A-Za-z0-9]", body), "" if open_right else "|"]
    whole = [t for i, t in enumerate(parts) if t and marks[i] not in ("", "*") and marks[i + 1] not in ("", "*")]
    return Rule(line, f"(?s){start}{pattern}{end}", tuple(dict.fromkeys(whole)), "allow" if allow else "block", len(line) + (1 << 20) * allow)


def rules_of(table: DataFrame, column: str = "line") -> list[Rule]:
    """The rules of a table of filter lines; null, empty and comment lines ('!') are none. A filter list is kept by people and doesn't grow with the pages; it is parsed on the driver, however long."""
    lines = table.select(F.trim(column).alias("line")).filter("line <> '' AND NOT startswith(line, '!')").distinct().collect()
    return [list_rule(r.line) for r in sorted(lines)]


def url_parts(name: str) -> tuple[Column, Column]:
    """Host and path of a url column; both empty for null and for urls without ://."""
    rest = F.when(F.instr(F.col(name), "://") > 0, F.expr(f"substring({name}, instr({name}, '://') + 3)")).otherwise("")
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _tokens(host: Column, path: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.concat_ws("/", host, path), TOKEN_BREAK), lambda t: t != ""))


def _rarest(urls: DataFrame, rules: list[Rule]) -> dict[str, list[Rule]]:
    """Rules by the token of theirs that the fewest urls have; ties go to the smaller token. Counts cover all urls and come back only for the rules' own tokens."""
    known = sorted({t for r in rules for t in r.tokens})
    marked = F.filter(F.col("tokens"), lambda t: t.isin(known)) if len(known) <= 10_000 else F.col("tokens")
    counts = urls.select(F.explode(marked).alias("t")).groupBy("t").count()
    if len(known) > 10_000:
        counts = counts.join(urls.sparkSession.createDataFrame([(t,) for t in known], "t string"), "t")
    df = {r.t: r["count"] for r in counts.collect()}
    index: dict[str, list[Rule]] = {}
    for r in rules:
        index.setdefault(min(r.tokens, key=lambda t: (df.get(t, 0), t)) if r.tokens else "", []).append(r)
    return index


def _inline(index: dict[str, list[Rule]], numbers: dict[Rule, int], tokens: Column) -> Column:
    """Numbers of a url's candidates: its tokens' entries in a hash table of literals. Rules without a literal token (entry '') always run."""
    table: list[list[tuple[str, int]]] = [[] for _ in range(BUCKETS)]
    for token, rules in index.items():
        if token:
            table[crc32(token.encode()) % BUCKETS] += [(token, numbers[r]) for r in rules]
    kind = "array<struct<token:string,number:int>>"
    slots = F.array(*(F.array(*(F.struct(F.lit(t).alias("token"), F.lit(n).alias("number")) for t, n in slot)).cast(kind) for slot in table))
    own = F.flatten(F.transform(tokens, lambda t: F.filter(F.get(slots, F.pmod(F.crc32(t.cast("binary")), F.lit(BUCKETS)).cast("int")), lambda e: e["token"] == t)))
    return F.concat(F.transform(own, lambda e: e["number"]), F.array(*(F.lit(numbers[r]) for r in index.get("", []))).cast("array<int>"))


def _fits(number: Column, place: Column, rules: list[Rule]) -> Column:
    """Whether the rule of that number fits. Its pattern is a literal, compiled once."""
    cases = F.when(number == 0, place.rlike(rules[0].pattern))
    for n, r in enumerate(rules[1:], 1):
        cases = cases.when(number == n, place.rlike(r.pattern))
    return cases.otherwise(False)


def judge_urls(pages: DataFrame, rules: list[Rule], default: str = "allow", url: str = "url", inline: int = 128) -> DataFrame:
    """pages with host, path, rule and verdict after its own columns; one row per input row.

    The highest rank wins; among equal ranks the greatest name. Rules of rank
    0 or less give a verdict but no rule; no fitting rule: 'default'. Null urls
    and urls without :// have empty host and path and fit no rule with a literal
    token. Repeated urls are judged alike. Own columns named host, path, rule or
    verdict are replaced; all others stay.

    Up to 'inline' rules the index is a table of literals in the plan: no
    shuffle, so no hot token or url. Beyond it distinct urls join the index on
    the token, a join whose large partitions Spark splits.
    """
    words, best, own, joined = free(pages, "_tokens", "_best", "_url", "_key")
    host, path = url_parts(url)
    seen = pages.select(host.alias("host"), path.alias("path")).withColumn("tokens", _tokens(F.col("host"), F.col("path")))
    index = _rarest(seen, rules)
    numbers = {r: n for n, r in enumerate(rules)}
    rows = pages.withColumn(own, F.col(url))
    rows = rows.drop("host", "path", "rule", "verdict").withColumn("host", url_parts(own)[0]).withColumn("path", url_parts(own)[1])
    place = F.concat("host", "path")
    given = lambda n: F.struct(F.get(F.array(*(F.lit(r.rank) for r in rules)), n).alias("rank"), F.get(F.array(*(F.lit(r.name) for r in rules)), n).alias("name"), F.get(F.array(*(F.lit(r.verdict) for r in rules)), n).alias("verdict"))
    if not rules:
        judged = rows.withColumn(best, F.lit(None).cast("struct<rank:int,name:string,verdict:string>"))
    elif len(rules) <= inline:
        tokens = rows.withColumn(words, _tokens(F.col("host"), F.col("path")))
        fitting = F.filter(_inline(index, numbers, F.col(words)), lambda n: _fits(n, place, rules))
        judged = tokens.withColumn(best, F.array_max(F.transform(fitting, given))).drop(words)
    else:
        filed = pages.sparkSession.createDataFrame([(t, r.rank, r.name, r.pattern, r.verdict) for t, rs in index.items() if t for r in rs], "t string, rank int, name string, pattern string, verdict string")
        places = seen.distinct().withColumn("t", F.explode("tokens"))
        fits = places.join(filed, "t").filter(F.regexp_like(place, F.col("pattern"))).groupBy(place.alias(joined)).agg(F.max(F.struct("rank", "name", "verdict")).alias(best))
        judged = rows.join(fits, place == F.col(joined), "left").drop(joined)
        if "" in index:  # rules without a literal token: they run on each url where it stands
            kind = "array<struct<rank:int,name:string,verdict:string,pattern:string>>"
            bare = F.array(*(F.struct(F.lit(r.rank).alias("rank"), F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"), F.lit(r.pattern).alias("pattern")) for r in index[""])).cast(kind)
            hit = F.transform(F.filter(bare, lambda r: F.regexp_like(place, r["pattern"])), lambda r: F.struct(r["rank"].alias("rank"), r["name"].alias("name"), r["verdict"].alias("verdict")))
            judged = judged.withColumn(best, F.array_max(F.concat(hit, F.array(best))))
    out = judged.withColumn("rule", F.when(F.col(best)["rank"] > 0, F.col(best)["name"])).withColumn("verdict", F.coalesce(F.col(best)["verdict"], F.lit(default)))
    return out.drop(best, own)
