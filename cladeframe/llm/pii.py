"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides (operator 8, SQL functions only)."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe.llm._common import Scratch

#: Base kinds in the contract's order, then the kinds that only the method finds.
BASE = ("email", "ip", "card", "phone")
EXTRA = ("spoken_email", "local_phone", "ssn", "iban", "ipv6", "person", "address")
KINDS = BASE + EXTRA

#: Gazetteers (public lists, shortened to the frequent): given names, street words, mail endings, calling codes, IBAN countries.
GIVEN = (
    "Adam|Alexander|Alice|Amanda|Amy|Andrea|Andreas|Andrew|Angela|Ann|Anna|Anthony|Antonio|Barbara|Ben|Benjamin|Brian|Carlos|Carmen|Caroline|Catherine|Charles|Charlotte|Christian|Christine|Christopher|Claire|Claudia|"
    "Daniel|David|Deborah|Diana|Edward|Elena|Elizabeth|Emily|Emma|Eric|Eva|Felix|Fernando|Francisco|Frank|George|Hans|Helen|Henry|Isabel|Jack|Jacques|James|Jan|Jane|Javier|Jean|Jennifer|Jessica|Johann|Johannes|John|Jorge|"
    "Joseph|Juan|Julia|Julie|Karen|Karl|Katharina|Kevin|Klaus|Laura|Linda|Lisa|Louis|Lucas|Luis|Manuel|Marco|Margaret|Maria|Marie|Mark|Martin|Mary|Matthew|Max|Michael|Michel|Miguel|Monica|Nancy|Nicolas|Nicole|Olivia|Oscar|"
    "Patricia|Patrick|Paul|Pedro|Peter|Philip|Pierre|Rachel|Richard|Robert|Rosa|Ruth|Sabine|Samuel|Sandra|Sarah|Sebastian|Simon|Sofia|Sophie|Stefan|Stephen|Steven|Susan|Teresa|Thomas|Ursula|Victor|Werner|William|Wolfgang"
)
STREETS = "Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Court|Square|Terrace|Way"
STRASSEN = "stra(?:ß|ss)e|str\\.|weg|platz|allee|gasse"
VIES = "rue|avenue|boulevard|place|chemin|Calle|Avenida|Plaza|Paseo"
_SURNAME = "\\p{Lu}[\\p{Ll}'’]{1,30}(?:-\\p{Lu}\\p{Ll}{1,30})?"
#: Java patterns that match as the contract's do, without backtracking: a run starts where no run character stands
#: before it, or at the end of the last match (\G), and what can't be given back is possessive.
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
PATTERN = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "spoken_email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}\x20?(?:[\[(]at[\])]|\x20at\x20)\x20?[a-z0-9-]{1,63}(?:\x20?(?:[\[(]dot[\])]|\x20dot\x20)\x20?[a-z0-9-]{1,63})++",
    "local_phone": r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-]?[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,4})?(?![A-Z0-9])",
    "ipv6": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "person": rf"(?=\p{{Lu}}\p{{Ll}}{{1,15}}\x20\p{{Lu}})(?<![\p{{L}}-])(?:{GIVEN})\x20(?:\p{{Lu}}\.\x20)?{_SURNAME}(?![\p{{L}}])",
    "address": rf"(?=[0-9\p{{Lu}}])(?<![0-9\p{{L}}])(?:[0-9]{{1,5}}[A-Za-z]?\x20(?:\p{{Lu}}\p{{Ll}}{{1,20}}\x20){{1,3}}(?:{STREETS})(?![\p{{L}}])|[0-9]{{1,4}},?\x20(?:{VIES})(?:\x20\p{{L}}{{1,20}}){{1,4}}|\p{{Lu}}\p{{Ll}}{{2,25}}(?:{STRASSEN})\x20[0-9]{{1,4}}[a-z]?(?![0-9\p{{L}}]))",
}
#: A cheap test that any text with a match passes.
_HINT = {
    "email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "spoken_email": r"[\[(\x20][dD][oO][tT][\])\x20]",
    "local_phone": r"[0-9]{3}[\x20.-][0-9]{4}", "ssn": r"-[0-9]{2}-", "iban": r"[A-Z]{2}[0-9]{2}", "ipv6": r":[0-9A-Fa-f]{1,4}:",
    "person": r"\p{Lu}\p{Ll}+\x20(?:\p{Lu}\.\x20)?\p{Lu}", "address": r"[0-9][A-Za-z]?,?\x20\p{L}|\p{L}\.?\x20[0-9]",
}

ENDINGS = "com|net|org|edu|gov|io|co|info|biz|de|fr|es|it|uk|us|eu|nl|ch|at|ca|au|jp|cn|in|br|ru|pl|se|no|dk|fi|be|pt|mx"
CALLING = "1|7|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|51|52|53|54|55|56|57|58|60|61|62|63|64|65|66|81|82|84|86|90|91|92|93|94|95|98"
IBAN_COUNTRIES = "AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IT|LT|LU|LV|MT|NL|NO|PL|PT|RO|SE|SI|SK"
GAZETTEER = {
    "email": rf"(?i)\.(?:{ENDINGS})$", "spoken_email": rf"(?i)(?:{ENDINGS})$", "phone": rf"^\+(?:{CALLING})[^0-9]?[0-9]", "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6)", "iban": rf"^(?:{IBAN_COUNTRIES})",
    "local_phone": r"^\(?[2-9]", "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)", "ip": r"^(?!0\.|127\.)", "ipv6": r"^(?!0{1,4}:0)",
    "person": rf"^(?:{GIVEN})\x20(?!(?:{STREETS}|University|College|School|Hospital|Church|Airport|Day|Island|Prize|Award|Inc|Ltd|GmbH)(?!\p{{L}}))", "address": rf"(?:{STREETS})$|\x20(?:{VIES})\x20|(?:{STRASSEN})",
}
STRICT = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,24}$", "ip": r"^(?:(?:0|[1-9][0-9]{0,2})\.){3}(?:0|[1-9][0-9]{0,2})$", "card": r"^(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){2,3}(?:[\x20-][0-9]{1,4})?|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})$", "phone": r"^\+[1-9][0-9]{0,2}(?:[\x20.-]?\(?[0-9]{1,4}\)?){2,5}$",
    "spoken_email": r"(?i)[\[(]at[\])].*[\[(]dot[\])]|\x20at\x20.*\x20dot\x20", "local_phone": r"^\([0-9]{3}\)\x20?[0-9]{3}-[0-9]{4}$|^[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}$", "ssn": r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$", "iban": r"^[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)$", "ipv6": r"^[0-9A-Fa-f:]+$",
    "person": r"^\p{Lu}\p{Ll}+\x20(?:\p{Lu}\.\x20)?\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?$", "address": r"^[1-9][0-9]{0,4}[A-Za-z]?,?\x20|\x20[1-9][0-9]{0,3}[a-z]?$",
}
NEAR = r"(?i)(?:e-?mail|contact|write|phone|tel|call|fax|mobile|cell|whatsapp|sms|card|visa|master|amex|credit|ip\b|address|host|server|ssn|social|iban|account|konto|correo|courriel|telefon|téléphone|teléfono|name|dear|mr|mrs|ms|dr|herr|frau|signed|sincerely|regards|lives?|street|delivery|ship|born)[^\n]{0,24}$"
AGAINST = r"(?i)(?:version|release|\bv|isbn|issn|doi|order|invoice|#|\$|€|£|no\.|nr\.|page|figure|fig\.|section|chapter)\x20?$"
LABELERS = ("strict", "structure", "gazetteer", "context", "against")
#: EM rounds, the prior count of its estimates, rounds of the classifier and its ridge.
ROUNDS, PRIOR, NEWTON, RIDGE = 50, 1.0, 12, 1.0


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _valid(kind: Column, m: Column) -> Column:
    """The contract's test of a base match; extra kinds take every match as a candidate."""
    ip = m.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$")
    card = F.length(_digits(m)).between(12, 19) & F.call_function("luhn_check", _digits(m))
    return F.when(kind == KINDS.index("ip"), ip).when(kind == KINDS.index("card"), card).when(kind == KINDS.index("phone"), F.length(_digits(m)).between(9, 15)).otherwise(True)


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Elements that a running sum walks with one growing array; an array of any length is walked in pieces of so many.
PIECE = 128


def _scan(items: Column, state: Column, step, out: str) -> Column:
    """The concatenated outputs of step(state, item) -> (state, array of out), item by item.

    An array that grows by one element is copied each time, so the walk goes by pieces: what is copied then is a
    piece, and the list of the pieces.
    """

    def walk(v: Column) -> Column:
        n = F.size(v)

        def piece(acc: Column, c: Column) -> Column:
            inside = F.transform(F.sequence(c * PIECE, F.least(c * PIECE + PIECE, n) - 1), lambda i: F.get(v, i))

            def one(a: Column, x: Column) -> Column:
                after, made = step(a["s"], x)
                return F.struct(after.alias("s"), F.concat(a["o"], made).alias("o"))

            done = F.aggregate(inside, F.struct(acc["s"].alias("s"), F.array().cast(f"array<{out}>").alias("o")), one)
            return _let(done, lambda d: F.struct(d["s"].alias("s"), F.concat(acc["o"], F.array(d["o"])).alias("o")))

        start = F.struct(state.alias("s"), F.array().cast(f"array<array<{out}>>").alias("o"))
        walked = F.aggregate(F.sequence(F.lit(0), F.floor((n - 1) / PIECE).cast("int")), start, piece, lambda a: F.flatten(a["o"]))
        return F.when(n > 0, walked).otherwise(F.array().cast(f"array<{out}>"))

    return _let(items, walk)


_SPAN = "struct<kind:int,start:int,end:int,m:string,before:string,after:string>"
_PAIR = "struct<g:string,m:string,next:string>"


def _pairs(text: Column, kind: str) -> Column:
    """The matches of a kind, each with the gap before it and the one after it; none where the hint fails."""
    gaps = F.split(text, PATTERN[kind], -1)
    zipped = F.arrays_zip(gaps.alias("g"), F.regexp_extract_all(text, F.lit(PATTERN[kind]), F.lit(0)).alias("m"), F.slice(gaps, 2, F.size(gaps)).alias("next")).cast(f"array<{_PAIR}>")
    return F.when(text.rlike(_HINT[kind]), zipped).otherwise(F.array().cast(f"array<{_PAIR}>"))


def _spans(text: Column, kinds: tuple[str, ...]) -> Column:
    """Valid matches of all kinds with their places in code points, and the 40 characters before and the one after them
    in the gaps between the matches of a kind: lengths of the gaps and matches add up to places."""
    none = F.array().cast(f"array<{_SPAN}>")

    def each(found: Column) -> Column:
        def step(at: Column, p: Column) -> tuple[Column, Column]:
            start = at + F.length(p["g"])
            end = start + F.coalesce(F.length(p["m"]), F.lit(0))
            span = F.struct(found["kind"].alias("kind"), start.alias("start"), end.alias("end"), p["m"].alias("m"), F.right(p["g"], F.lit(40)).alias("before"), F.left(p["next"], F.lit(1)).alias("after"))
            return end, F.when(p["m"].isNotNull() & _valid(found["kind"], p["m"]), F.array(span)).otherwise(none)

        return _scan(found["pairs"], F.lit(0), step, _SPAN)

    listed = F.array(*(F.struct(F.lit(KINDS.index(k)).alias("kind"), _pairs(text, k).alias("pairs")) for k in kinds))
    return F.flatten(F.transform(F.filter(listed, lambda f: F.size(f["pairs"]) > 1), each))


def _apart(base: Column, extra: Column) -> Column:
    """The extra spans that touch no base span, by two walks over all in the order of their places: what reaches over, what begins inside."""
    side = lambda c, n: F.transform(c, lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("side"), s["end"].alias("end"), s.alias("span")))
    order = F.sort_array(F.concat(side(base, 0), side(extra, 1)))
    kind = f"struct<start:int,side:int,end:int,span:{_SPAN},free:boolean>"

    def onward(reach: Column, x: Column) -> tuple[Column, Column]:
        seen = F.struct(x["start"].alias("start"), x["side"].alias("side"), x["end"].alias("end"), x["span"].alias("span"), (reach <= x["start"]).alias("free"))
        return F.when(x["side"] == 0, F.greatest(reach, x["end"])).otherwise(reach), F.array(seen)

    def back(begin: Column, x: Column) -> tuple[Column, Column]:
        free = (x["side"] == 1) & x["free"] & (x["end"] <= begin)
        return F.when(x["side"] == 0, x["start"]).otherwise(begin), F.when(free, F.array(x["span"])).otherwise(F.array().cast(f"array<{_SPAN}>"))

    return F.reverse(_scan(F.reverse(_scan(order, F.lit(0), onward, kind)), F.lit(2**31 - 1), back, _SPAN))


def _matches(m: Column, patterns: dict[str, str], kind: Column) -> Column:
    """Whether a match is as the pattern of its kind says."""
    return F.rlike(m, F.get(F.split(F.lit("\n".join(patterns[k] for k in KINDS)), "\n"), kind))


def _is(kind: Column, *names: str) -> Column:
    return kind.isin([KINDS.index(n) for n in names])


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _structure(kind: Column, m: Column) -> Column:
    """A vote on shape: checksums, lengths, and digits that are not all one."""
    d, n = _digits(m), F.length(m)
    size, same = F.length(d), d.rlike(r"^([0-9])\1+$")
    iban = F.length(F.regexp_replace(m, " ", "")).between(15, 34)
    return (
        F.when(_is(kind, "card"), _vote(F.call_function("luhn_check", d), F.lit(True)))
        .when(_is(kind, "phone", "local_phone"), _vote(size.between(10, 14), same))
        .when(_is(kind, "iban"), _vote(iban & m.rlike("[0-9]{6}"), ~iban | ~m.rlike("[0-9]{6}")))
        .when(_is(kind, "ssn"), _vote(~same, F.lit(True)))
        .when(_is(kind, "person"), _vote(n.between(6, 40), m.rlike(r"\p{Lu}{3}")))
        .when(_is(kind, "address"), _vote(n.between(8, 60), size == 0))
        .when(_is(kind, "email", "spoken_email"), _vote(n.between(6, 120) & ~m.rlike(r"\.\.|@-|-@"), m.rlike(r"\.\.|@-|-@")))
        .otherwise(_vote(m.rlike("[1-9]"), F.lit(True)))
    )


def _voted(span: Column) -> Column:
    """The span with the votes of the labelers, -1, 0 or 1, and a length class."""
    kind, m, before = span["kind"], span["m"], span["before"]
    around = F.concat(F.right(before, F.lit(1)), F.lit("|"), span["after"])
    table = lambda patterns: F.when(_matches(m, patterns, kind), 1).otherwise(-1)
    votes = F.array(
        table(STRICT), _structure(kind, m), table(GAZETTEER), F.when(before.rlike(NEAR), 1).otherwise(0), F.when(before.rlike(AGAINST) | around.rlike(r"[A-Za-z0-9_]\||\|[A-Za-z0-9_]"), -1).otherwise(0)
    )
    return F.struct(kind.alias("kind"), span["start"].alias("start"), span["end"].alias("end"), votes.alias("votes"), F.least(F.length(m).bitwiseAND(0xFFFF) / 8, F.lit(3)).cast("int").alias("size"))


def fit(patterns: list[tuple[int, list[int], int, int]]) -> tuple[list[float], float]:
    """Weights of the classifier and its threshold from (kind, votes, size, count): at most 11 * 3^5 * 4 rows, whatever the corpus.

    EM under conditional independence: each labeler has, for real and for false spans, a chance of voting each
    way; each kind has its share of real spans. The chance of a span being real is then the soft label of a
    logistic regression on kind, votes and length class, fitted by Newton steps with a ridge.
    """
    kinds, m = len(KINDS), len(LABELERS)
    share = [0.7] * kinds
    table = [[[0.15, 0.25, 0.6] if real else [0.5, 0.3, 0.2] for real in (0, 1)] for _ in range(m)]

    def real(kind: int, votes: list[int]) -> float:
        a, b = math.log(share[kind]), math.log(1 - share[kind])
        for j, v in enumerate(votes):
            a += math.log(table[j][1][v + 1])
            b += math.log(table[j][0][v + 1])
        return 1 / (1 + math.exp(max(-700.0, min(700.0, b - a))))

    for _ in range(ROUNDS if patterns else 0):
        soft = [real(k, v) for k, v, _, _ in patterns]
        up, down = [PRIOR * 2] * kinds, [PRIOR] * kinds
        votes = [[[PRIOR + (v == 2 and r) + (v == 0 and not r) for v in range(3)] for r in (0, 1)] for _ in range(m)]
        for (k, v, _, n), p in zip(patterns, soft, strict=True):
            up[k] += n * p
            down[k] += n * (1 - p)
            for j in range(m):
                votes[j][1][v[j] + 1] += n * p
                votes[j][0][v[j] + 1] += n * (1 - p)
        share = [a / (a + b) for a, b in zip(up, down, strict=True)]
        table = [[[c / sum(row) for c in row] for row in pair] for pair in votes]

    width = kinds + m + 1
    weights = [0.0] * width
    rows = [([float(k == q) for q in range(kinds)] + [float(x) for x in v] + [s / 3], real(k, v), float(n)) for k, v, s, n in patterns]
    for _ in range(NEWTON if rows else 0):
        slope = [-RIDGE * w for w in weights]
        curve = [[RIDGE * (i == j) for j in range(width)] for i in range(width)]
        for x, y, n in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(x, weights, strict=True))))))
            w = n * p * (1 - p)
            for i in (i for i in range(width) if x[i]):
                slope[i] += n * (y - p) * x[i]
                for j in range(width):
                    curve[i][j] += w * x[i] * x[j]
        weights = [a + b for a, b in zip(weights, _solve(curve, slope), strict=True)]
    return weights, 0.0


def _solve(a: list[list[float]], b: list[float]) -> list[float]:
    """Gaussian elimination of a small positive definite system."""
    a = [[*row, x] for row, x in zip(a, b, strict=True)]
    n = len(a)
    for i in range(n):
        for r in range(i + 1, n):
            f = a[r][i] / a[i][i]
            a[r] = [x - f * y for x, y in zip(a[r], a[i], strict=True)]
    out = [0.0] * n
    for i in reversed(range(n)):
        out[i] = (a[i][n] - sum(a[i][j] * out[j] for j in range(i + 1, n))) / a[i][i]
    return out


def _joined(spans: Column) -> Column:
    name = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(documents: DataFrame) -> DataFrame:
    """Personal data in every whole text: doc_id, n_email, n_ip, n_card, n_phone, n_extra, base_sha256 and spans.

    Needs doc_id and text; other columns are ignored. Base spans are those of the contract's patterns and are always
    returned. The method adds spans of the kinds in EXTRA: spoken addresses, phone numbers without a plus, social
    security numbers, IBANs, IPv6 addresses, names of persons and street addresses. Strict patterns, checksums and shapes, gazetteers and the words
    before and characters around a candidate vote on every span of the corpus; the counts of the vote patterns (a
    few thousand at most, however large the corpus is) go through EM, which estimates how reliable the labelers
    are, and train the classifier that decides on the extra spans that touch no base span. All work on texts is row by row in SQL functions; only the counting
    of patterns shuffles, as partial counts. Offsets are code points, the end exclusive. A null text is empty; each
    row is judged by itself, so repeated rows give repeated results.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "personal-data")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = docs.select("doc_id", F.when(F.col("text").rlike(rf"[0-9@]|{_HINT['spoken_email']}|{_HINT['person']}"), _spans(F.col("text"), KINDS)).alias("s"))
    found = found.select("doc_id", F.filter("s", lambda x: x["kind"] < len(BASE)).alias("b"), F.filter("s", lambda x: x["kind"] >= len(BASE)).alias("x"))
    extra = F.when((F.size("x") > 0) & (F.size("b") > 0), _apart(F.col("b"), F.col("x"))).otherwise(F.col("x"))
    # The table is small: offsets and votes of the few spans, whatever the texts are.
    spans = scratch.write(found.select("doc_id", F.transform(F.concat("b", extra), _voted).alias("s")), "spans")

    each = spans.select(F.explode("s").alias("s")).groupBy("s.kind", "s.votes", "s.size").agg(F.count("*").alias("n"))
    weights, least = fit([(r["kind"], list(r["votes"]), r["size"], r["n"]) for r in each.collect()])
    kinds, m = len(KINDS), len(LABELERS)

    def passes(s: Column) -> Column:
        by_kind = F.get(F.array(*(F.lit(w) for w in weights[:kinds])), s["kind"])
        score = reduce(lambda a, j: a + F.lit(weights[kinds + j]) * F.get(s["votes"], j), range(m), by_kind + s["size"] / 3 * F.lit(weights[-1]))
        return score > least

    kept = F.filter(F.coalesce("s", F.array().cast("array<struct<kind:int,start:int,end:int,votes:array<int>,size:int>>")), lambda s: (s["kind"] < len(BASE)) | passes(s))
    placed = F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    out = spans.select("doc_id", F.sort_array(placed).alias("s"))
    count = lambda test: F.size(F.filter("s", lambda s: test(s["kind"]))).cast("long")
    return out.select(
        "doc_id",
        *(count(lambda k, n=n: k == n).alias(f"n_{name}") for n, name in enumerate(BASE)),
        count(lambda k: k >= len(BASE)).alias("n_extra"),
        F.sha2(_joined(F.filter("s", lambda s: s["kind"] < len(BASE))).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("s")).alias("spans"),
    )
