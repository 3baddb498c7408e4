"""Personal data by weak supervision, in DataFrame functions alone.

Candidate spans come from strict patterns (the base, which always stays) and from loose ones, of more kinds. Five labelers
look at each, independently: whether it is written as its kind usually is, whether a gazetteer knows a part of it, whether the words before
it name its kind, whether it stands apart from other letters and digits, and whether it looks as if made by chance (many
different characters). Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is for
each kind; a logistic classifier on the votes and on features of span and context, fitted on the resulting posteriors, then
decides on every loose span.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut

#: Kinds with strict patterns, and those that only the classifier adds.
KINDS, MORE_KINDS = ("email", "ip", "card", "phone"), ("iban", "secret")
ALL_KINDS = KINDS + MORE_KINDS
LABELERS = ("form", "known", "context", "apart", "varied")
FEATURES = ("strict", "long", "marks", "digits", "quoted")
#: First guesses of each labeler's chance of a vote of 1 for real and for other spans; they weigh as GUESS spans.
FIRST, GUESS = {"form": (0.95, 0.4), "known": (0.8, 0.3), "context": (0.8, 0.1), "apart": (0.95, 0.6), "varied": (0.95, 0.5)}, 10
#: A loose span stays if the classifier is at least this sure.
SURE = 0.9
ROUNDS = 50

# Possessive forms of the contract's patterns: the same matches without backtracking, and in linear time and flat stacks.
# A run that can't begin a match is tried once, at its start or where the last match ended (\G).
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\]|@)\x20?[A-Za-z0-9-]++\x20?(?:\(dot\)|\[dot\])\x20?[A-Za-z]{2,24}+",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}+:){7}[0-9A-Fa-f]{1,4}+(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9.+-])3[47][0-9]{2}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5}(?![0-9-])",
    "phone": r"(?<![0-9+.-])\(?[2-9][0-9]{2}\)?[\x20.-][2-9][0-9]{2}[\x20.-][0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3}+)?+(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{20,}+=?+=?+(?![A-Za-z0-9_+/=-])",
}
#: Without a match of the gate a text has no span of the kind.
GATES = {
    "email": "@|[(\\[]at[)\\]]", "ip": r"[0-9]\.[0-9]|[0-9A-Fa-f]:[0-9A-Fa-f]", "card": "[0-9]", "phone": "[0-9]",
    "iban": "[A-Z]{2}[0-9]{2}", "secret": "[A-Za-z0-9_+/-]{20}",
}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

# What the gazetteer knows. Domains: the oldest generic ones, those reserved for examples, and country codes
# of ISO 3166; addresses: special blocks of RFC 6890; cards: ranges of ISO 7812 issuers; phones: country codes of E.164;
# accounts: countries of the IBAN registry; secrets: prefixes that issuers of keys publish.
GENERIC = "com org net edu gov mil int info biz name pro coop museum aero io ai app dev cloud online shop site xyz tech test example invalid"
COUNTRIES = (
    "ad ae al ar at au az ba be bg bh br by ca ch ci cl cn co cr cu cy cz de dk do dz ec ee eg es eu fi fo fr gb ge gi gl gr gt hk hr hu id ie il in iq ir is it jm jo jp"
    " ke kr kw kz lb li lk lt lu lv ly ma mc md me mk mr mt mu mx my ng nl no nz om pa pe ph pk pl ps pt py qa ro rs ru sa sc se sg si sk sm st sv th tl tn tr tw ua uk us uy uz va ve vg vn xk za"
)
IBAN_COUNTRIES = "ad ae al at az ba be bg bh br by ch cr cy cz de dk do ee eg es fi fo fr gb ge gi gl gr gt hr hu ie il iq is it jo kw kz lb lc li lt lu lv ly mc md me mk mr mt mu nl no pk pl ps pt qa ro rs sa sc sd se si sk sm st sv tl tn tr ua va vg xk"
KEY_PREFIXES = "AKIA ASIA AIza ghp_ gho_ ghs_ ghu_ github_pat_ glpat- xoxb- xoxp- xoxa- sk- sk_live_ pk_live_ rk_live_ SG. eyJ npm_ pypi- dop_v1_ hf_"
NAMES = {
    "email": "mail email e-mail contact write reach kontakt correo courriel schreib",
    "ip": "ip address addresses server host adresse dirección login from",
    "card": "card visa credit amex mastercard karte carte tarjeta payment kreditkarte",
    "phone": "tel phone telephone call mobile fax cell anruf telefon móvil teléfono appel téléphone",
    "iban": "iban account konto compte cuenta bank",
    "secret": "token secret password passwd pwd key apikey api_key api-key auth authorization bearer credential credentials",
}
_any = lambda words, end="": "(?:" + "|".join(w.replace(".", r"\.") for w in words.split()) + f"){end}"
KNOWN = {
    "email": rf"(?i)(?:\.|[)\]]\x20?){_any(GENERIC + ' ' + COUNTRIES)}$",
    "ip": r"(?i)^(?:10|127|172|192|198|203|2001|fe80|fd[0-9a-f]{2})[.:]",
    "card": r"^(?:3[47]|4|5[1-5]|2[2-7]|6)",
    "phone": r"^(?:\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})|\(?(?:[2-9][0-9]{2}))",
    "iban": rf"(?i)^{_any(IBAN_COUNTRIES)}",
    "secret": rf"^{_any(KEY_PREFIXES)}",
}
CONTEXT = {k: rf"(?i)(?<![\p{{L}}\p{{N}}]){_any(NAMES[k])}(?:\W*\w+){{0,2}}\W*$" for k in ALL_KINDS}
CONTEXT["secret"] = rf"(?i)(?<![\p{{L}}\p{{N}}]){_any(NAMES['secret'])}[\"'\]]?\s*(?:[:=]|is|\s)[\s\"'`]*$"
_SPAN = "array<struct<start:bigint,end:bigint,hit:string,before:string,after:string>>"


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(hit: Column, least: int, most: int) -> Column:
    d = _digits(hit)
    n = F.length(d)

    def add(total: Column, i: Column) -> Column:
        x = F.substring(d, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(x > 9, x - 9).otherwise(x)

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)
    return F.when(n.between(least, most), total % 10 == 0).otherwise(False)


def _iban(hit: Column) -> Column:
    """Whether the check digits hold: 1 modulo 97, with letters as 10 to 35 and the first four characters at the end."""
    s = F.replace(hit, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(code < 58, rest * 10 + code - 48).otherwise(rest * 100 + code - 55) % 97

    return F.when(F.length(s).between(15, 34), F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1).otherwise(False)


def _fits(kind: str, hit: Column, strict: bool) -> Column:
    """Whether a match is a candidate at all: sizes, ranges and check digits."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return hit.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$") | F.lit(not strict)
    if kind == "card":
        return _luhn(hit, 16 if strict else 15, 19)
    if kind == "phone":
        return F.length(_digits(hit)).between(8, 15)
    if kind == "iban":
        return _iban(hit)
    return hit.rlike("[0-9].*[0-9].*[0-9]") & hit.rlike("[A-Za-z].*[A-Za-z].*[A-Za-z]")


#: What the spans of a kind are usually written like, and what they are not.
FORMS = {
    "email": (r"^[A-Za-z0-9].*[A-Za-z]{2}$", r"\.\.|\.@|@-"),
    "ip": (r"^[0-9A-Fa-f:.]+$", r"^0|[.:]0[0-9]{3}|[.]0[0-9]"),
    "card": (r"^(?:[0-9]+|[0-9]{4}(?:[\x20-][0-9]{4})+(?:[\x20-][0-9]{1,3})?|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})$", "^0|(.)\\1{7}"),
    "phone": (r"^\+?[0-9(]", r"[\x20.-]{3}|\([^)]*$|^[^(]*\)|\.\."),
    "iban": (r"^[A-Z0-9]+$|^.{4}(?:\x20.{4})+(?:\x20.{1,3})?$", "(.)\\1{7}"),
    "secret": ("^[A-Za-z0-9]", r"[a-z]{12}|[A-Z]{12}|--|__|//|[/_-][a-z]+[/_-]"),
}


def _form(kind: str, hit: Column) -> Column:
    like, unlike = FORMS[kind]
    return hit.rlike(like) & ~hit.rlike(unlike)


def _spans(text: Column, pattern: str, gate: Column, keep: Callable[[Column], Column]) -> Column:
    """Leftmost matches that don't overlap and pass `keep`, as places in code points, with the end of the text before each
    and the character after it. Two scans: what lies between the matches, and the matches."""
    none = F.expr(f"cast(array() AS {_SPAN})")
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rows = F.transform(hits, lambda h, i: F.struct(F.get(gaps, i).alias("gap"), h.alias("hit"), F.left(F.get(gaps, i + 1), F.lit(1)).alias("after")))

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + F.char_length(x["gap"]).cast("long")
        end = start + F.char_length(x["hit"]).cast("long")
        one = F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit"), F.right(x["gap"], F.lit(40)).alias("before"), x["after"].alias("after"))
        return F.struct(end.alias("at"), F.when(keep(x["hit"]), F.concat(done["out"], F.array(one))).otherwise(done["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("out"))
    return F.when(gate, F.aggregate(rows, start, step, lambda x: x["out"])).otherwise(none)


def _for(kind: str, f: Callable[[str, Column], Column]) -> Callable[[Column], Column]:
    """The function of a span alone (Spark counts the parameters of a lambda)."""
    return lambda s: f(kind, s)


def _apart(span: Column, others: Column) -> Column:
    return ~F.exists(others, lambda o: (o["start"] < span["end"]) & (span["start"] < o["end"]))


def _once(rows: DataFrame, keep: list[str], columns: dict[str, Column]) -> DataFrame:
    """rows with new columns that are worked out once per row: the optimiser doesn't merge expressions over a generator,
    and so doesn't repeat them inside later lambdas."""
    return rows.select(*keep, F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def _found(docs: DataFrame) -> DataFrame:
    """(doc_id, base_<kind>, loose_<kind>): the strict spans that pass, and the loose ones that overlap none of these."""
    text, first, loose = F.col("text"), {}, {}
    for kind in ALL_KINDS:
        gate = text.rlike(GATES[kind])
        if kind in KINDS:
            first[f"base_{kind}"] = _spans(text, STRICT[kind], gate, _for(kind, lambda k, h: _fits(k, h, True)))
        first[f"wide_{kind}"] = _spans(text, LOOSE[kind], gate, _for(kind, lambda k, h: _fits(k, h, False)))
    base = F.concat(*(F.col(f"base_{k}") for k in KINDS))
    for kind in ALL_KINDS:
        loose[f"loose_{kind}"] = F.filter(f"wide_{kind}", lambda s: _apart(s, base))
    rows = _once(docs, ["doc_id"], first)
    return _once(rows, ["doc_id", *(f"base_{k}" for k in KINDS)], loose)


def _votes(kind: str, span: Column) -> list[Column]:
    """1, 0 or null (no vote) of each labeler."""
    for_ = lambda c: F.when(c, 1).otherwise(0)
    hit = span["hit"]
    other = "|".join(CONTEXT[k] for k in ALL_KINDS if k != kind)
    known = hit.rlike(KNOWN[kind])
    different = F.size(F.array_distinct(F.split(F.left(hit, F.lit(64)), "")))
    return [
        for_(_form(kind, hit)),
        F.when(known, 1) if kind == "secret" else for_(known),  # keys without a prefix are usual, without a name before them they are not
        F.when(span["before"].rlike(CONTEXT[kind]), 1).when(F.lit(kind == "secret") | span["before"].rlike(other), 0),
        for_(~span["before"].rlike(r"[\p{L}\p{N}]$") & ~F.coalesce(span["after"], F.lit("")).rlike(r"^[\p{L}\p{N}]")),
        for_(different >= {"secret": 10, "iban": 6, "email": 6}.get(kind, 4)),
    ]


def _features(kind: str, span: Column, strict: bool) -> list[Column]:
    """0 or 1 of each further feature of the span and its context."""
    hit = span["hit"]
    return [
        F.lit(int(strict)), (F.char_length(hit) > 24).cast("int"), hit.rlike(r"[\x20()/_.-]").cast("int"),
        (2 * F.length(_digits(hit)) >= F.char_length(hit)).cast("int"), span["before"].rlike("[\"'`<(\\[=:]\\s?$").cast("int"),
    ]


def _vote_row(kind: str, span: Column, strict: bool) -> Column:
    columns = [*zip(_votes(kind, span), LABELERS, strict=True), *zip(_features(kind, span, strict), FEATURES, strict=True)]
    return F.struct(F.lit(kind).alias("kind"), *(v.alias(n) for v, n in columns))


def _strict_vote(kind: str, span: Column) -> Column:
    return _vote_row(kind, span, True)


def _loose_vote(kind: str, span: Column) -> Column:
    return _vote_row(kind, span, False)


def vote_counts(found: DataFrame) -> list[tuple[str, tuple, tuple, int]]:
    """(kind, votes, features, number of spans) for every pattern, counted over all documents: at most 6 * 3**2 * 2**8 rows."""
    votes = [F.transform(f"base_{k}", _for(k, _strict_vote)) for k in KINDS] + [F.transform(f"loose_{k}", _for(k, _loose_vote)) for k in ALL_KINDS]
    rows = found.select(F.explode(F.concat(*votes)).alias("v")).select("v.*").groupBy("kind", *LABELERS, *FEATURES).agg(F.count("*").alias("n"))
    return sorted(((r.kind, tuple(r[x] for x in LABELERS), tuple(r[x] for x in FEATURES), r.n) for r in rows.collect()), key=str)


def reliabilities(counts: list[tuple[str, tuple, tuple, int]]) -> tuple[dict[tuple, float], dict[tuple[str, str], list[float]]]:
    """EM over vote patterns, with a prior of each kind: posteriors of (kind, votes), and for each kind and labeler its chances
    of a vote for real and for other spans. Smoothed, so that a labeler without votes keeps its first guess."""
    kinds = {k for k, *_ in counts}
    hit = {(k, x): list(FIRST[x]) for k in kinds for x in LABELERS}  # chance of a vote of 1 if real, if not
    prior = dict.fromkeys(kinds, 0.5)
    total: dict[tuple, int] = {}
    for kind, votes, _, n in counts:
        total[kind, votes] = total.get((kind, votes), 0) + n
    post: dict[tuple, float] = {}
    for _ in range(ROUNDS):
        for kind, votes in total:
            odds = math.log(prior[kind] / (1 - prior[kind]))
            for x, v in zip(LABELERS, votes, strict=True):
                if v is not None:
                    p, q = hit[kind, x]
                    odds += math.log(p / q) if v else math.log((1 - p) / (1 - q))
            post[kind, votes] = 1 / (1 + math.exp(-max(-30, min(30, odds))))
        for kind in kinds:
            own = [(v, n, post[k, v]) for (k, v), n in total.items() if k == kind]
            prior[kind] = min(0.95, max(0.05, (sum(n * p for _, n, p in own) + 1) / (sum(n for _, n, _ in own) + 2)))
            for i, x in enumerate(LABELERS):
                for real in (0, 1):
                    part = [(v[i], n * (p if real == 0 else 1 - p)) for v, n, p in own if v[i] is not None]
                    rate = (sum(w for v, w in part if v) + GUESS * FIRST[x][real]) / (sum(w for _, w in part) + GUESS)
                    hit[kind, x][real] = min(0.99, max(0.01, rate))
    return post, hit


def inputs(kind: str, votes: tuple, features: tuple) -> list[float]:
    """Of the classifier: a bias, the kind, votes (1 for, -1 against, 0 none) and features."""
    return [1.0, *(float(kind == k) for k in ALL_KINDS), *(0.0 if v is None else 2.0 * v - 1 for v in votes), *map(float, features)]


def classifier(counts: list[tuple[str, tuple, tuple, int]]) -> list[float]:
    """Weights of a logistic classifier on inputs(), fitted on the posteriors, each pattern by the root of its count."""
    post, _ = reliabilities(counts)
    rows = [(inputs(kind, votes, features), post[kind, votes], math.sqrt(n)) for kind, votes, features, n in counts]
    w = [0.0] * len(inputs("", (None,) * len(LABELERS), (0,) * len(FEATURES)))
    total = sum(n for _, _, n in rows) or 1.0
    for _ in range(800):
        g = [0.002 * x for x in w]
        for x, y, n in rows:
            p = 1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(w, x, strict=True))))))
            g = [a + n / total * (p - y) * b for a, b in zip(g, x, strict=True)]
        w = [a - 0.5 * b for a, b in zip(w, g, strict=True)]
    return w


def _accepted(kind: str, span: Column, w: list[float]) -> Column:
    z = F.lit(w[0] + w[1 + ALL_KINDS.index(kind)])
    at = 1 + len(ALL_KINDS)
    for weight, vote in zip(w[at:], _votes(kind, span), strict=False):
        z = z + F.coalesce(2 * vote - 1, F.lit(0)) * F.lit(weight)
    for weight, feature in zip(w[at + len(LABELERS) :], _features(kind, span, False), strict=True):
        z = z + feature * F.lit(weight)
    return z >= math.log(SURE / (1 - SURE))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> (doc_id, base_<kind>, spans_<kind>): arrays of (start, end, hit, before, after) with places in code points, end
    exclusive, in order. base_ is there for the kinds email, ip, card and phone; spans_ holds base_ and the loose spans that
    the classifier takes, of these kinds and of iban and secret.

    Null and empty texts have no spans. Null ids and repeated rows are kept, other columns ignored; an empty table gives
    an empty result, and without candidates no loose span is ever taken. Texts are scanned once: the spans found are
    written to the shared folder.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = cut(_found(docs))
    weights = classifier(vote_counts(found))
    spans = {}
    for kind in ALL_KINDS:
        more = F.filter(f"loose_{kind}", _for(kind, lambda k, s: _accepted(k, s, weights)))
        spans[f"spans_{kind}"] = F.array_sort(F.concat(f"base_{kind}", more) if kind in KINDS else more)
    return _once(found, ["doc_id", *(f"base_{k}" for k in KINDS)], spans)


def span_list(prefix: str) -> Column:
    """kind:start:end of all kinds in order, comma-joined."""
    kinds = KINDS if prefix == "base" else ALL_KINDS
    parts = [F.transform(f"{prefix}_{k}", _for(k, lambda k, s: F.concat_ws(":", F.lit(k), s["start"], s["end"]))) for k in kinds]
    return F.array_join(F.concat(*parts), ",")


def redact(docs: DataFrame, mark: str = "[{}]", text_col: str = "text") -> DataFrame:
    """docs with every strict span of the text that passes replaced by its kind's mark, kind by kind; other columns as they
    were, whatever their names. Null texts stay null; null ids and repeated rows are rows like any other; an empty table gives
    an empty one."""
    text = F.col(text_col)
    for kind in KINDS:
        gaps, hits = F.split(text, STRICT[kind], -1), F.regexp_extract_all(text, F.lit(STRICT[kind]), F.lit(0))
        marked = F.transform(hits, _for(kind, lambda k, h: F.when(_fits(k, h, True), F.lit(mark.format(k))).otherwise(h)))
        joined = F.zip_with(gaps, marked, lambda g, m: F.concat(g, F.coalesce(m, F.lit(""))))
        text = F.when(text.isNull(), text).when(text.rlike(GATES[kind]), F.array_join(joined, "")).otherwise(text)
    return docs.withColumn(text_col, text)
