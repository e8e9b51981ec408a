"""Personal data by weak supervision, in DataFrame expressions only.

Patterns propose spans.  Three labelers vote on each (for, against, abstain):
a regex labeler on the strictness of its form, a gazetteer labeler on known
domains, prefixes and key words, a context labeler on the words before it and
the characters beside it.  Expectation-maximisation over the counts of vote
patterns estimates how reliable each labeler is, and its posteriors train a
logistic span classifier on the counts of span features.  The classifier
decides on proposed spans beyond the base patterns; base spans always stay.
Only counts of patterns, a few hundred numbers whatever the input, come to the
driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import materialize

KINDS = ("email", "ip", "card", "phone", "secret")

# Possessive quantifiers match what greedy ones would here, without deep recursion.  A run of characters
# is entered at its start or where the last match ended: elsewhere in it a match would fail as it did there.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
NATIONAL = r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z-])"
SPELLED = r"[A-Za-z0-9._%+-]{1,64}+\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]{1,63}+(?:\x20?[\[(](?:dot|DOT)[\])]\x20?[A-Za-z0-9-]{1,63}+|\.[A-Za-z0-9-]{1,63}+){1,8}+"
SECRET = r"(?<![0-9A-Za-z_-])(?:[0-9a-f]{32,}+|(?:sk|pk|ghp|AKIA|xox[abp])[_-]?[0-9A-Za-z_-]{16,}+)(?![0-9A-Za-z_-])"

DOMAINS = r"(?i)\.(?:com|org|net|edu|gov|io|de|fr|es|uk|eu|info|example|test)$"
CUES = {
    "email": r"(?i)(?:e-?mail|contact|write|mailto|address|reach)[^A-Za-z0-9]{0,6}(?:(?:me|us|to|at|is)[^A-Za-z0-9]{0,3}){0,2}$",
    "ip": r"(?i)(?:ip|host|server|address|addr|from|client)[^A-Za-z0-9]{0,6}$",
    "card": r"(?i)(?:card|visa|mastercard|amex|credit|payment|pan)[^A-Za-z0-9]{0,6}(?:(?:no|number|nr)[^A-Za-z0-9]{0,4})?$",
    "phone": r"(?i)(?:phone|tel|call|fax|mobile|cell|whatsapp|ring)[^A-Za-z0-9]{0,6}(?:(?:me|us|at|on|is)[^A-Za-z0-9]{0,3}){0,2}$",
    "secret": r"(?i)(?:token|secret|password|passwd|api_?key|access_?key|key|auth)[\"']?[\x20]{0,3}[:=][\x20]{0,3}[\"']?$",
}


CHUNK = 128


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, also where a lambda asks for it often."""
    return F.transform(F.array(value), use)[0]


def _scan(items: Column, zero: Column, step, emit) -> Column:
    """emit(state, x) for each x, where ``step`` takes the state from item to item.

    An array that grows by an element costs its whole length each time, so
    results grow in chunks, and only one state for each chunk grows over all."""
    chunked = lambda z: F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / CHUNK).cast("int")), lambda i: F.slice(z, i * CHUNK + 1, CHUNK))
    grown = lambda state, out: F.struct(state.alias("state"), out.alias("out"))
    none = lambda x: F.slice(F.array(x), 1, 0)

    def heads(chunks: Column) -> Column:
        return F.aggregate(chunks, grown(zero, none(zero)), lambda a, c: grown(F.aggregate(c, a["state"], step), F.concat(a["out"], F.array(a["state"]))), lambda a: a["out"])

    def inner(c: Column, state: Column) -> Column:
        return F.aggregate(c, grown(state, none(emit(state, c[0]))), lambda a, x: grown(step(a["state"], x), F.concat(a["out"], F.array(emit(a["state"], x)))), lambda a: a["out"])

    whole = lambda z: _let(chunked(z), lambda chunks: F.flatten(F.zip_with(chunks, heads(chunks), inner)))
    return _let(items, lambda z: F.when(F.size(z) > 0, whole(z)))


def _cuts(text: Column, pattern: str, guard: Column) -> Column:
    """The leftmost non-overlapping matches of a pattern and the gaps around them."""
    return F.when(guard, F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps")))


def _placed(cuts: Column) -> Column:
    """array<struct<s, e, m, b, a>> of the matches in ``_cuts``: start,
    exclusive end (code points), the matched text, up to 32 characters before
    it (back to the match before at most) and the one after it."""
    found, gaps, n = cuts["found"], cuts["gaps"], F.size(cuts["found"])
    blank = F.array(F.lit(""))
    zipped = F.arrays_zip(F.slice(gaps, 1, n).alias("g"), found.alias("m"), F.slice(gaps, 2, n).alias("h"), F.slice(F.concat(blank, found), 1, n).alias("p"), F.slice(F.concat(found, blank), 2, n).alias("q"))
    sizes = F.transform(zipped, lambda x: F.struct(F.length(x["g"]).alias("g"), F.length(x["m"]).alias("n"), x["m"].alias("m"), F.right(F.concat(x["p"], x["g"]), F.lit(32)).alias("b"), F.left(F.concat(F.left(x["h"], F.lit(1)), F.left(x["q"], F.lit(1))), F.lit(1)).alias("a")))
    emit = lambda at, x: F.struct((at + x["g"]).alias("s"), (at + x["g"] + x["n"]).alias("e"), x["m"].alias("m"), x["b"].alias("b"), x["a"].alias("a"))
    return F.when(n > 0, _scan(sizes, F.lit(0), lambda at, x: at + x["g"] + x["n"], emit))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    digits = F.reverse(F.split(x, ""))
    value = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") < 5, d.cast("int") * 2).otherwise(d.cast("int") * 2 - 9)))
    return F.aggregate(value, F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid_ip(x: Column) -> Column:
    return ~F.exists(F.split(x, r"\."), lambda p: ~p.rlike("^0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]{0,2})$"))


def _valid_card(x: Column) -> Column:
    d = _digits(x)
    return F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(F.lit(False))


def _valid_phone(x: Column) -> Column:
    return F.length(_digits(x)).between(9, 15)


def _spans(kind: str, found: Column, base) -> Column:
    """array<struct<k, s, e, base, r, g, c, w, n, d>>: kind number, place,
    whether a base span, the three votes and three features."""
    number = KINDS.index(kind)

    def one(x: Column) -> Column:
        before, after = x["b"], x["a"]
        last = F.right(before, F.lit(1))
        cue = before.rlike(CUES[kind])
        glued = last.rlike(r"[\p{L}\p{N}_]") | after.rlike(r"[\p{L}\p{N}_]")
        good = base(x["m"])
        digits = _digits(x["m"])
        regex = {"email": F.when(good, 1).otherwise(0), "ip": F.when(good, 1).otherwise(-1), "card": F.when(good, 1).otherwise(-1), "phone": F.when(good, 1).otherwise(F.when(F.length(digits) == 10, 0).otherwise(-1)), "secret": F.when(x["m"].rlike("[0-9]") & x["m"].rlike("[a-z]"), 1).otherwise(-1)}[kind]
        gazetteer = {
            "email": F.when(x["m"].rlike(DOMAINS), 1).otherwise(0),
            "ip": F.when(x["m"].rlike(r"^(?:0|127|255)\."), -1).otherwise(0),
            "card": F.when(digits.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)"), 1).otherwise(-1),
            "phone": F.when(digits.rlike("555") | x["m"].rlike(r"^\+(?:1|33|34|44|49)"), 1).otherwise(0),
            "secret": F.when(before.rlike(r"(?i)(?:token|secret|password|passwd|key|auth|bearer)"), 1).otherwise(0),
        }[kind]
        context = F.when(cue, 1).when(glued, -1).otherwise(0)
        share = F.length(digits) / F.length(x["m"])
        return F.struct(
            F.lit(number).alias("k"), x["s"].alias("s"), x["e"].alias("e"), good.alias("base"), regex.alias("r"), gazetteer.alias("g"), context.alias("c"),
            F.when(cue, 2).when(glued, 1).otherwise(0).alias("w"), F.least((x["e"] - x["s"]) / 6, F.lit(7.0)).cast("int").alias("n"), F.when(share <= 0, 0).when(share < 0.5, 1).when(share < 1, 2).otherwise(3).alias("d"),
        )

    return F.coalesce(F.transform(found, one), F.array().cast(_SPANS))


_SPANS = "array<struct<k:int,s:int,e:int,base:boolean,r:int,g:int,c:int,w:int,n:int,d:int>>"


def propose(docs: DataFrame) -> DataFrame:
    """``docs`` with __tl_base and __tl_extra: valid base spans and all other
    proposals that meet none of them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    digit = text.rlike("[0-9]")
    yes = lambda m: F.lit(True)
    no = lambda m: F.lit(False)
    guards = {"ip": digit & text.rlike(r"[0-9]\.[0-9]++\.[0-9]"), "card": digit & text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), "national": digit & text.rlike(r"[0-9]{3}[.-][0-9]{4}")}
    raw = F.array(
        _cuts(text, EMAIL, text.contains("@")),
        _cuts(text, IP, guards["ip"]),
        _cuts(text, CARD, guards["card"]),
        _cuts(text, PHONE, text.contains("+") & digit),
        _cuts(text, NATIONAL, guards["national"]),
        _cuts(text, SPELLED, text.rlike(r"[\[(](?:at|AT)[\])]")),
        _cuts(text, SECRET, text.rlike(r"[0-9A-Za-z_-]{18}")),
    )
    found = docs.withColumn("__tl_found", F.transform(raw, _placed))  # one array for each pattern
    kinds = (("email", 0, yes), ("ip", 1, _valid_ip), ("card", 2, _valid_card), ("phone", 3, _valid_phone), ("phone", 4, no), ("email", 5, no), ("secret", 6, no))
    spans = found.withColumn("__tl_all", F.concat(*(_spans(k, F.col("__tl_found")[i], base) for k, i, base in kinds))).drop("__tl_found")
    both = _let(F.col("__tl_all"), lambda z: F.struct(F.filter(z, lambda x: x["base"]).alias("base"), F.when(F.exists(z, lambda x: ~x["base"]), _clear(z)).alias("extra")))
    spans = spans.withColumn("__tl_both", both).drop("__tl_all")
    return spans.withColumns({"__tl_base": F.col("__tl_both.base"), "__tl_extra": F.coalesce("__tl_both.extra", F.array().cast(_SPANS))}).drop("__tl_both")


def _clear(spans: Column) -> Column:
    """The spans beyond the base ones that meet no base span.

    In the order of starts a span meets a base span before it if the greatest
    end of those lies beyond its start, and one after it if the next of those
    starts before its end."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["base"].alias("base"), x.alias("x"))))
    ahead = _scan(ordered, F.lit(-1), lambda end, x: F.when(x["base"], F.greatest(end, x["e"])).otherwise(end), lambda end, x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["base"].alias("base"), x["x"].alias("x"), (end > x["s"]).alias("met")))
    back = _scan(F.reverse(ahead), F.lit((1 << 31) - 1), lambda start, x: F.when(x["base"], x["s"]).otherwise(start), lambda start, x: F.struct(x["x"].alias("x"), (x["base"] | x["met"] | (start < x["e"])).alias("met")))
    return F.transform(F.filter(back, lambda x: ~x["met"]), lambda x: x["x"])


def reliabilities(counts: list[tuple[int, int, int, int, int]], rounds: int = 50) -> tuple[dict, dict]:
    """EM over (kind, regex, gazetteer, context votes, count) rows.

    Returns the posterior that a span is personal data for each (kind, votes)
    and, for each kind and labeler, P(vote | class) with one pseudo-count.
    The start trusts a vote for or against by 0.8, so classes keep their sense.
    """
    posterior, tables = {}, {}
    for kind in sorted({c[0] for c in counts}):
        rows = [c for c in counts if c[0] == kind]
        prior = 0.5
        start = {1: (0.6, 0.15), 0: (0.3, 0.3), -1: (0.1, 0.55)}
        p = [{v: start[v] for v in start} for _ in range(3)]
        q: dict = {}
        for _ in range(rounds):
            for r in rows:
                yes, no = math.log(prior), math.log(1 - prior)
                for j in range(3):
                    yes += math.log(p[j][r[1 + j]][0])
                    no += math.log(p[j][r[1 + j]][1])
                q[r[1:4]] = 1 / (1 + math.exp(min(60.0, max(-60.0, no - yes))))
            total = sum(r[4] for r in rows)
            positive = sum(r[4] * q[r[1:4]] for r in rows)
            prior = (positive + 1) / (total + 2)
            for j in range(3):
                own = {v: [start[v][0] * 4, start[v][1] * 4] for v in start}
                for r in rows:
                    own[r[1 + j]][0] += r[4] * q[r[1:4]]
                    own[r[1 + j]][1] += r[4] * (1 - q[r[1:4]])
                sums = [sum(own[v][k] for v in own) for k in (0, 1)]
                p[j] = {v: (own[v][0] / sums[0], own[v][1] / sums[1]) for v in own}
        posterior |= {(kind, *v): x for v, x in q.items()}
        tables[kind] = p
    return posterior, tables


def _features(kind: int, r: int, g: int, w: int, n: int, d: int) -> tuple[str, ...]:
    return ("one", f"k{kind}", f"k{kind}w{w}", f"k{kind}n{n}", f"k{kind}d{d}", f"k{kind}g{g}", f"k{kind}r{r}")


def fit_classifier(rows: list[tuple], posterior: dict, steps: int = 300, rate: float = 0.5) -> dict[str, float]:
    """Logistic weights of span features, from counts and soft labels."""
    weights: dict[str, float] = {}
    data = [(_features(k, r, g, w, n, d), posterior[(k, r, g, c)], count) for k, r, g, c, w, n, d, count in rows]
    if not data:
        return weights
    total = sum(x[2] for x in data)
    seen: dict[str, float] = {}
    for names, _, count in data:
        for f in names:
            seen[f] = seen.get(f, 0) + count
    for _ in range(steps):
        grad: dict[str, float] = {}
        for names, y, count in data:
            z = sum(weights.get(f, 0.0) for f in names)
            e = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y) * count
            for f in names:
                grad[f] = grad.get(f, 0.0) + e
        for f, g in grad.items():
            weights[f] = weights.get(f, 0.0) - rate * (g / (seen[f] + 0.01 * total) + 1e-4 * weights.get(f, 0.0))
    return weights


def _classifier(weights: dict[str, float]):
    def logit(x: Column) -> Column:
        z = F.lit(float(weights.get("one", 0.0)))
        for kind in range(len(KINDS)):
            own = F.lit(float(weights.get(f"k{kind}", 0.0)))
            for name in "wngdr":
                table = {f: v for f, v in weights.items() if f.startswith(f"k{kind}{name}")}
                if table:
                    pick = None
                    for f, v in sorted(table.items()):
                        level = int(f[len(f"k{kind}{name}") :])
                        pick = F.when(x[name] == level, v) if pick is None else pick.when(x[name] == level, v)
                    own = own + pick.otherwise(0.0)
            z = z + F.when(x["k"] == kind, own).otherwise(0.0)
        return z

    return logit


def find_pii(docs: DataFrame, keep_text: bool = True, threshold: float = 0.5) -> DataFrame:
    """``docs`` with spans: array<struct<kind, s, e, base>> by kind, then start.

    Starts and ends count code points, ends are exclusive.  base marks the
    spans of the four base patterns; the others were proposed beside them and
    the classifier gives them ``threshold`` or more.  A null text is empty; a
    text is read whole, in time that grows with its length and not with its
    square whatever it holds; a column named spans is replaced, those whose
    names begin with __tl_ are this module's own; rows are independent, so
    repeated rows get the same spans; an empty table has none.  ``keep_text`` False leaves the
    text out of the working table.
    """
    source = docs.drop("spans")
    found = propose(source)
    work = materialize(found if keep_text else found.drop("text"), "pii-proposals")
    each = work.select(F.explode(F.concat("__tl_base", "__tl_extra")).alias("x")).select("x.*")
    patterns = each.groupBy("k", "r", "g", "c", "w", "n", "d").agg(F.count("*").alias("m")).collect()  # at most a few hundred
    votes: dict = {}
    for r in patterns:
        key = (r["k"], r["r"], r["g"], r["c"])
        votes[key] = votes.get(key, 0) + r["m"]
    posterior, _ = reliabilities([(*k, m) for k, m in sorted(votes.items())])
    logit = _classifier(fit_classifier(sorted(tuple(r[c] for c in ("k", "r", "g", "c", "w", "n", "d", "m")) for r in patterns), posterior))
    cut = math.log(threshold / (1 - threshold))
    added = F.filter("__tl_extra", lambda x: logit(x) >= cut)
    brief = lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["base"].alias("base"))
    spans = F.array_sort(F.transform(F.concat("__tl_base", added), brief))
    name = lambda k: F.element_at(F.array(*(F.lit(n) for n in KINDS)), k + 1)
    named = F.transform(spans, lambda x: F.struct(name(x["k"]).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["base"].alias("base")))
    return work.withColumn("spans", named).drop("__tl_base", "__tl_extra")


def redact(found: DataFrame) -> DataFrame:
    """The text of ``find_pii``'s rows with every span as ``<KIND>``.

    Where spans meet, the earliest start gives the name and the union of the
    spans is replaced; text outside spans stays as it is.  The text is cut in
    blocks of ``CHUNK`` spans and each block at its spans, so a long text with
    many spans is not walked from its start for each.
    """
    text = F.col("text")
    ordered = F.array_sort(F.transform("spans", lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("o"), x["kind"].alias("kind"))))
    kept = _scan(ordered, F.lit(0), lambda at, x: F.greatest(at, -x["o"]), lambda at, x: F.struct(at.alias("lo"), x["s"].alias("hi"), x["kind"].alias("kind")))
    fresh = F.filter(kept, lambda x: x["hi"] >= x["lo"])
    chunks = _let(fresh, lambda z: F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / CHUNK).cast("int")), lambda i: F.slice(z, i * CHUNK + 1, CHUNK)))

    def named(c: Column) -> Column:
        base = c[0]["lo"]
        block = F.substring(text, base + 1, F.element_at(c, -1)["hi"] - base)
        return _let(block, lambda t: F.array_join(F.transform(c, lambda x: F.concat(F.substring(t, x["lo"] - base + 1, x["hi"] - x["lo"]), F.lit("<"), F.upper(x["kind"]), F.lit(">"))), ""))

    last = F.array_max(F.transform("spans", lambda x: x["e"]))
    whole = F.concat(F.array_join(F.transform(chunks, named), ""), F.substring(text, last + 1, F.length(text)))
    return found.withColumn("text", F.when(F.size("spans") > 0, whole).otherwise(text))


def pii_digest(docs: DataFrame) -> DataFrame:
    found = find_pii(docs.select("doc_id", "text"), keep_text=False)
    base = F.filter("spans", lambda x: x["base"])
    line = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
    count = lambda k: F.size(F.filter(base, lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in KINDS[:4]), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))
