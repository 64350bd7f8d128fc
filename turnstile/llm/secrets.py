"""Secret scans with a trigram index.

Each rule is a regular expression. From its syntax tree follows a Boolean query over trigrams that every match must
contain: alternatives of sets that have to be there together. An index of the rules' trigrams is built over all texts
(in lower case): postings (trigram, document). For each alternative the postings are intersected by counting, and only
documents left over are searched with the rule. Rules without mandatory trigrams search every text.

Spans are found by splitting a text at a rule's matches: the lengths of what lies between and of the matches
themselves, summed up, are the places, in code points. Everything is DataFrame work; no text leaves the JVM.

Edge cases: a null text is empty and has no spans; rows that share a doc_id share their candidates, which only means
that more is searched; a null doc_id is one too; texts of any length are searched whole; other columns are not read.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parse
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstile.llm.common import maybe_in, staged


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern` (in the syntax that Java, RE2 and Python share) whose `group` has `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + either_case("api") + "_?" + either_case("key")
#: Rules whose spans make the digest.
BASE = [
    Rule("assign", f"({_NAMES})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    # A run that is too short holds no longer one, so the least length can be part of the pattern.
    Rule("access", "AKIA[A-Z0-9]{12,}"),
    Rule("hex", "[0-9a-f]{32,}"),
]
MORE = [
    Rule("private_key", "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{10,}"),
]
RULES = BASE + MORE

#: Most strings that a part of a pattern may stand for, to be spelled out.
SPELLED = 64


def _spelled(node) -> set[str] | None:
    """All strings, in lower case, that one element of a pattern matches; None if too many."""
    op, value = node
    if op is sre.LITERAL:
        return {chr(value).lower()}
    if op is sre.IN:
        if any(k is sre.NEGATE or k is sre.CATEGORY for k, _ in value):
            return None
        chars = {chr(c) for k, v in value for c in (range(v[0], v[1] + 1) if k is sre.RANGE else [v])}
        out = {c.lower() for c in chars}
        return out if len(out) <= 4 else None
    if op is sre.SUBPATTERN:
        return _all_spelled(list(value[3]))
    if op is sre.BRANCH:
        parts = [_all_spelled(list(b)) for b in value[1]]
        return None if any(p is None for p in parts) or sum(map(len, parts)) > SPELLED else set().union(*parts)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[1] <= 4:
        own = _all_spelled(list(value[2]))
        if own is None:
            return None
        out = {"".join(p) for n in range(value[0], value[1] + 1) for p in product(sorted(own), repeat=n)}
        return out if len(out) <= SPELLED else None
    return None


def _all_spelled(nodes: list) -> set[str] | None:
    out = {""}
    for node in nodes:
        own = _spelled(node)
        if own is None or len(out) * len(own) > SPELLED:
            return None
        out = {a + b for a in out for b in own}
    return out


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives of trigrams that must all be there; empty: nothing is mandatory."""
    best: list[frozenset[str]] = []
    run: set[str] = {""}

    def close() -> None:
        # A run in a row that every match goes through: one of its strings is there, and with it all its trigrams.
        nonlocal best, run
        options = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run}
        if options and all(options) and (not best or min(map(len, options)) > min(map(len, best))):
            best = sorted((o for o in options if not any(p < o for p in options)), key=sorted)
        run = {""}

    def walk(nodes: list) -> None:
        nonlocal run
        for node in nodes:
            own = _spelled(node)
            if own is not None and len(run) * len(own) <= SPELLED:
                run = {a + b for a in run for b in own}
                continue
            close()
            if own is not None:
                run = own
                continue
            op, value = node
            if op is sre.SUBPATTERN:
                walk(list(value[3]))
                close()
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] >= 1:
                walk(list(value[2]))
                close()

    walk(list(sre_parse.parse(pattern)))
    close()
    return best


def postings(docs: DataFrame, trigrams: list[str], doc_id: str, text: str) -> DataFrame:
    """gram, doc: which of the trigrams, in lower case, stand in which document."""
    low = docs.select(F.col(doc_id).alias("doc"), F.lower(text).alias("low"))
    there = F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(k)) for k, t in enumerate(trigrams)])
    return low.select("doc", there.alias("there")).select("doc", F.explode(F.array_compact("there")).alias("gram")).distinct()


def candidates(docs: DataFrame, rules: list[Rule], doc_id: str, text: str) -> tuple[DataFrame | None, list[int]]:
    """(doc, found: numbers of the rules to search for), and the numbers of the rules that search every text."""
    queries = {k: trigram_query(r.pattern) for k, r in enumerate(rules)}
    grams = sorted({g for q in queries.values() for alt in q for g in alt})
    everywhere = [k for k, q in queries.items() if not q]
    if not grams:
        return None, everywhere
    spark = docs.sparkSession
    wanted = [(k, a, grams.index(g), len(alt)) for k, q in queries.items() for a, alt in enumerate(q) for g in alt]
    table = spark.createDataFrame(wanted, "rule int, alt int, gram int, size int")  # as long as the rules are
    met = postings(docs, grams, doc_id, text).join(F.broadcast(table), "gram").groupBy("doc", "rule", "alt").agg(F.count("*").alias("n"), F.min("size").alias("size"))
    return met.where("n = size").groupBy("doc").agg(F.collect_set("rule").alias("found")), everywhere


def spans(text: Column, rule: Rule, number: int) -> Column:
    """Array of (start, number, end) of a rule's matches."""
    between = F.split(text, rule.pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = whole if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    kind = "array<struct<start:int,number:int,end:int>>"
    zipped = F.arrays_zip(F.transform(between, F.length).alias("gap"), F.transform(whole, F.length).alias("size"), F.transform(part, F.length).alias("part"))
    size = lambda x: F.coalesce(x["size"], F.lit(0))  # noqa: E731  the text after the last match has none
    steps = F.transform(zipped, lambda x: F.struct((x["gap"] + size(x)).alias("end"), size(x).alias("size"), F.coalesce(x["part"], F.lit(-1)).alias("part")))

    def doubled(acc: Column, power: Column) -> Column:
        # Sums of twice as many neighbours: after all powers below the number of matches, `end` counts from the text's start.
        back = F.call_function("shiftleft", F.lit(1), power)
        end = lambda x, i: x["end"] + F.coalesce(F.get(acc, i - back)["end"], F.lit(0))
        longer = F.transform(acc, lambda x, i: F.struct(end(x, i).alias("end"), x["size"].alias("size"), x["part"].alias("part")))
        return F.when(back < F.size(acc), longer).otherwise(acc)

    def listed(acc: Column) -> Column:
        long_enough = F.filter(acc, lambda x: x["part"] >= rule.least)
        return F.transform(long_enough, lambda x: F.struct((x["end"] - x["size"]).alias("start"), F.lit(number).alias("number"), x["end"].alias("end")))

    found = F.aggregate(F.sequence(F.lit(0), F.lit(30)), steps, doubled, listed)
    return F.when(F.regexp_like(text, F.lit(rule.pattern)), found).otherwise(F.array().cast(kind))


def _written(found: Column, rules: list[Rule]) -> Column:
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["number"]), s["start"], s["end"])), ",")


def scanned(docs: DataFrame, rules: list[Rule] = RULES, base: int = len(BASE), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_<kind> of the first `base` rules, base_sha256 of their spans, and all spans, "kind:start:end" by start."""
    rows = docs.select(F.col(doc_id).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found, everywhere = candidates(docs, rules, doc_id, text)
    kind = "array<struct<start:int,number:int,end:int>>"
    none = F.array().cast(kind)

    def searched(df: DataFrame, numbers: list[int], wanted: Column | None) -> DataFrame:
        parts = [spans(F.col("text"), rules[k], k) if wanted is None or k in everywhere else F.when(F.array_contains(wanted, k), spans(F.col("text"), rules[k], k)).otherwise(none) for k in numbers]
        return df.select("doc", F.sort_array(F.concat(none, *parts)).alias("spans"))

    if found is None:
        out = searched(rows, everywhere, None)
    else:
        found = staged(found, "secret-candidates")
        key, member = F.xxhash64("doc"), F.xxhash64("of")
        found = found.withColumnRenamed("doc", "of")
        some = maybe_in(rows, key, found, member).join(found, F.col("doc").eqNullSafe(F.col("of")), "left")
        rest = maybe_in(rows, key, found, member, there=False)
        out = searched(some, list(range(len(rules))), F.coalesce("found", F.array().cast("array<int>"))).unionByName(searched(rest, everywhere, None))
    of_base = F.filter("spans", lambda s: s["number"] < base)
    of_kind = lambda k: F.filter("spans", lambda s: s["number"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{rules[k].kind}") for k in range(base)]
    return out.select(F.col("doc").alias("doc_id"), *counts, F.sha2(_written(of_base, rules), 256).alias("base_sha256"), _written(F.col("spans"), rules).alias("spans"))
