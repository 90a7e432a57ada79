"""Personal data by weak supervision, in DataFrame expressions alone.

Patterns give base spans and further candidates.  Five labelers vote on each candidate (shape, checksum, gazetteer,
words before it, marks before it); expectation-maximisation on the counts of vote patterns (at most 3**5 rows) estimates
the labelers' reliabilities; the votes' posteriors train a naive Bayes span classifier on features of a bounded number
of values.  Base spans stay; candidates that the classifier takes for personal data are added.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonalith.llm.common import written

KINDS = ("email", "ip", "card", "phone", "key")
#: Possessive where the plain pattern cannot give back characters anyway: the same matches, without recursion.  An
#: address can only begin where its run of characters does, or where the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "key": r"(?:\G|(?<![A-Za-z0-9_]))[A-Za-z0-9_]{20,}+",
    "local": r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
#: A cheap test that a text must pass before its pattern is tried; 0 for none.
_GATES = {"email": "instr(text, '@') > 0", "ip": r"text rlike '[0-9]\\.[0-9]'", "card": r"text rlike '[0-9](?:[ -]?[0-9]){8}'", "phone": "instr(text, '+') > 0", "key": "text rlike '[A-Za-z0-9_]{20}'", "local": r"text rlike '[0-9]{3}[ .-][0-9]{4}'"}
#: Characters of a match that fails its kind's test from which it may be an added span; years and other short numbers are none.
LEAST = 9
#: Fixed values of the gazetteers.
DOMAINS = "com|org|net|edu|gov|io|info|de|fr|es|uk|it|nl|eu|ch|at"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38)"
COUNTRIES = r"^\\+(?:1|7|20|27|30|31|32|33|34|36|39|4[013456789]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
WORDS_FOR = "phone|tel|call|fax|mobile|card|visa|mastercard|amex|account|iban|ssn|token|key|secret|password|passwd|api|mail|contact|address|ip|host|server|login"
WORDS_AGAINST = "version|page|vol|volume|isbn|issn|year|figure|fig|table|section|chapter|license|rfc|build|release"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Matches whose places are added up together; so many such sums are added up in turn.
RUN = 128


def _all(name: str) -> Column:
    """The matches of a pattern as (s, e, t), code points from 0, end exclusive: what lies between them gives their places.

    Growing an array copies it, so places are added up by runs of RUN matches, then over runs.
    """
    step = f"a.at + length(p_{name}[i - 1])"
    row = f"named_struct('s', {step}, 'e', {step} + length(m_{name}[i - 1]), 't', m_{name}[i - 1])"
    none = "cast(array() as array<struct<s:int,e:int,t:string>>)"
    own = (
        f"transform(sequence(0, (size(m_{name}) - 1) div {RUN}), k -> aggregate(sequence(cast(k * {RUN} + 1 as int), cast(least(size(m_{name}), (k + 1) * {RUN}) as int)), named_struct('at', 0, 'out', {none}), "
        f"(a, i) -> named_struct('at', {step} + length(m_{name}[i - 1]), 'out', array_append(a.out, {row}))))"
    )
    # transform(array(x), q -> ...)[0] evaluates x once.
    begins = "aggregate(q, array(0), (b, x) -> array_append(b, element_at(b, -1) + x.at))"
    moved = "flatten(transform(q, (x, k) -> transform(x.out, y -> named_struct('s', y.s + b[k], 'e', y.e + b[k], 't', y.t))))"
    return F.expr(f"if(size(m_{name}) > 0, transform(array({own}), q -> transform(array({begins}), b -> {moved})[0])[0], {none})")


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _luhn(x: str) -> str:
    d = f"reverse({_digits(x)})"
    each = f"cast(substring({d}, i, 1) as int)"
    return f"(aggregate(sequence(1, length({d})), 0, (a, i) -> a + if(i % 2 = 0, 2 * {each} - if({each} > 4, 9, 0), {each})) % 10 = 0)"


_VALID = {
    "email": "true",
    "ip": "forall(split(x.t, '[.]'), p -> coalesce(try_cast(p as bigint) <= 255, length(regexp_replace(p, '^0+', '')) < 4 and cast(concat('0', right(p, 3)) as int) <= 255))",
    "card": f"(length({_digits('x.t')}) between 14 and 19 and if(length({_digits('x.t')}) between 14 and 19, {_luhn('x.t')}, false))",
    "phone": f"length({_digits('x.t')}) between 10 and 15",
}


def _vote(yes: str, no: str = "false") -> str:
    """2 for, 0 against, 1 abstains."""
    return f"case when {yes} then 2 when {no} then 0 else 1 end"


_LABELERS = {
    "shape": _vote("kind = 'email' or ok or kind = 'key' and length(digits) >= 4 and length(digits) <= length(t) - 4 or source = 'local' or kind = 'card' and length(digits) between 14 and 19", "kind in ('ip', 'phone') or kind = 'key' or length(digits) < 12"),
    "check": _vote(
        "kind = 'card' and luhn or kind = 'key' and t rlike '^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$' or kind = 'email' and t rlike '[.][A-Za-z]{2,6}$' or kind = 'phone' and t rlike '[ ().-]'",
        "kind = 'card' or kind = 'email' or kind = 'ip' and t rlike '^(?:0|22[4-9]|2[3-5][0-9])[.]'",
    ),
    "gazetteer": _vote(f"kind = 'email' and lower(t) rlike '[.](?:{DOMAINS})$' or kind = 'card' and digits rlike '{ISSUERS}' or kind = 'phone' and t rlike '{COUNTRIES}'", "kind = 'card' or kind = 'ip' and t rlike '^(?:10|127|192[.]168|0)[.]'"),
    "words": _vote(f"before rlike '(?:^|[^a-z])(?:{WORDS_FOR})[^a-z]'", f"before rlike '(?:^|[^a-z])(?:{WORDS_AGAINST})[^a-z]'"),
    "marks": _vote("""before rlike '[=:] ?["\\']?$'""", "before rlike '(?:[0-9][.,/]|[#$§v])$'"),
}
_FEATURES = {
    "kind": "concat(kind, '/', source)",
    "digits": "cast(case when length(digits) < 6 then 0 when length(digits) < 10 then 1 when length(digits) < 14 then 2 when length(digits) < 20 then 3 else 4 end as string)",
    "length": "cast(least(length(t) div 8, 9) as string)",
    "valid": "cast(ok as string)",
    "check": "cast(check as string)",
    "gazetteer": "cast(gazetteer as string)",
    "before": "case when before = '' then 'start' when before rlike '[ \\n\\t]$' then 'space' when before rlike '[a-z0-9]$' then 'word' else 'mark' end",
    "words": "cast(words as string)",
}


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, base and more, both arrays of (s, e, kind, ok, pattern, features): one row for each row of docs."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("*", *[F.expr(f"if({_GATES[k]}, regexp_extract_all(text, {_quoted(p)}, 0), cast(array() as array<string>))").alias(f"m_{k}") for k, p in PATTERNS.items()])
    rows = rows.select("*", *[F.expr(f"if(size(m_{k}) > 0, split(text, {_quoted(p)}, -1), cast(array() as array<string>))").alias(f"p_{k}") for k, p in PATTERNS.items()])
    rows = rows.select("doc_id", "text", *[_all(k).alias(k) for k in PATTERNS])
    struct = "named_struct('s', x.s, 'e', x.e, 'kind', '{kind}', 'source', '{source}', 'ok', {ok}, 't', x.t)"
    parts = [F.expr(f"transform({k}, x -> {struct.format(kind=k, source=k, ok=ok)})") for k, ok in _VALID.items()]
    parts.append(F.expr(f"transform(filter(key, x -> x.t rlike '[0-9]' and x.t rlike '[A-Za-z]'), x -> {struct.format(kind='key', source='key', ok='false')})"))
    parts.append(F.expr(f"transform(local, x -> {struct.format(kind='phone', source='local', ok='false')})"))
    rows = rows.select("doc_id", "text", F.concat(*parts).alias("all"))
    # Small matches that are no base spans, such as years, are no candidates.
    rows = rows.select("doc_id", "text", F.expr(f"filter(all, x -> x.ok or length(x.t) >= {LEAST})").alias("all"))
    digits = _digits("x.t")
    kept = ", ".join(f"'{f}', x.{f}" for f in ("s", "e", "kind", "source", "ok", "t"))
    luhn = f"x.kind = 'card' and if(length({digits}) between 2 and 30, {_luhn('x.t')}, false)"
    before = "lower(substring(text, greatest(x.s - 40, 0) + 1, least(40, x.s)))"
    wide = F.expr(f"transform(all, x -> named_struct({kept}, 'digits', {digits}, 'luhn', {luhn}, 'before', {before}))")
    return rows.select("doc_id", wide.alias("all"))


def _votes(rows: DataFrame) -> DataFrame:
    voted = rows.select("*", *[F.expr(v).alias(k) for k, v in _LABELERS.items()])
    pattern = sum((F.col(k) * 3**i for i, k in enumerate(_LABELERS)), F.lit(0))
    return voted.select("*", pattern.cast("int").alias("pattern"), F.array(*[F.expr(v) for v in _FEATURES.values()]).alias("features"))


def reliabilities(counts: dict[int, int], rounds: int = 50) -> tuple[list[float], list[list[list[float]]]]:
    """Posterior of each vote pattern, and P(vote | class) of each labeler, by expectation-maximisation.

    Starts from the majority of votes; a labeler's votes are taken as independent given the class.
    """
    n = len(_LABELERS)
    votes = [[p // 3**i % 3 for i in range(n)] for p in range(3**n)]
    posterior = [min(0.95, max(0.05, 0.5 + 0.15 * sum(v - 1 for v in own))) for own in votes]
    table: list[list[list[float]]] = []
    for _ in range(rounds):
        weight = [0.5, 0.5]
        table = [[[0.5] * 3, [0.5] * 3] for _ in range(n)]
        for p, c in counts.items():
            for k, share in ((0, 1 - posterior[p]), (1, posterior[p])):
                weight[k] += c * share
                for i, v in enumerate(votes[p]):
                    table[i][k][v] += c * share
        for own in table:
            for k in (0, 1):
                total = sum(own[k])
                own[k] = [x / total for x in own[k]]
        for p, own in enumerate(votes):
            odds = math.log(weight[1] / weight[0]) + sum(math.log(table[i][1][v] / table[i][0][v]) for i, v in enumerate(own))
            posterior[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return posterior, table


def _classifier(rows: DataFrame, posterior: list[float]) -> tuple[float, dict[str, float]]:
    """Naive Bayes log odds of each feature value, from soft labels; values are few by construction."""
    p = F.element_at(F.array(*map(F.lit, posterior)), F.col("pattern") + 1)
    each = rows.select(p.alias("p"), F.posexplode("features").alias("at", "value")).groupBy("at", "value").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()
    yes, no = (1 + sum(r[k] for r in each if r["at"] == 0) for k in ("yes", "no"))
    weights = {f"{r['at']}:{r['value']}": math.log((r["yes"] + 0.5) / (yes + 0.5)) - math.log((r["no"] + 0.5) / (no + 0.5)) for r in each}
    return math.log(yes / no), weights


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans for each row of docs(doc_id, text).

    Base spans are the matches of the four patterns that pass their test, kind by kind; spans holds these and the added
    ones that overlap none of them, as kind:start:end by start and kind, code points, end exclusive.  A null text is the
    empty one: no spans, and the sha256 of the empty string.  Repeated rows and null ids each give their row; an empty
    table gives none.  Other columns are not looked at.

    One pass over the texts, whose spans are written without the text they hold; they meet again by row in a shuffle of
    spans.  What meets on the driver is bounded: 243 vote patterns and about 60 feature values.
    """
    fields = "s e kind source ok t digits luhn before".split()
    found = candidates(docs).withColumn("row", F.monotonically_increasing_id()).select("doc_id", "row", F.explode_outer("all").alias("x"))
    rows = _votes(found.select("doc_id", "row", *[F.col(f"x.{f}").alias(f) for f in fields]))
    rows = written(rows.select("doc_id", "row", "s", "e", "kind", "ok", "pattern", "features"), "votes")
    voted = rows.filter(F.col("kind").isNotNull())
    counts = {r["pattern"]: r["n"] for r in voted.groupBy("pattern").agg(F.count("*").alias("n")).collect()}
    posterior, _ = reliabilities(counts)
    start, weights = _classifier(voted, posterior)
    odds = F.lit(start)
    if weights:
        of = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
        for i in range(len(_FEATURES)):
            odds = odds + F.coalesce(F.try_element_at(of, F.concat(F.lit(f"{i}:"), F.col("features")[i])), F.lit(0.0))
    rank = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)]), F.coalesce("kind", F.lit("key")))
    span = F.struct("s", rank.alias("rank"), "e", "kind")
    taken = rows.select("doc_id", "row", F.when(F.col("ok"), span).alias("base"), F.when(~F.col("ok") & (odds > 0), span).alias("more"))
    per = taken.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list("base")).alias("base"), F.sort_array(F.collect_set("more")).alias("more"))
    free = F.expr("filter(more, (x, i) -> not exists(base, b -> b.s < x.e and x.s < b.e) and not exists(slice(more, 1, i), b -> b.s < x.e and x.s < b.e))")
    per = per.select("doc_id", "base", F.sort_array(F.concat("base", free)).alias("spans"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
    of_kind = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return per.select("doc_id", *[of_kind(k) for k in KINDS[:4]], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))
