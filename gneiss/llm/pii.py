"""Personal data by candidate gradient boosting.

Generators propose spans: four strict ones, whose valid matches are always reported (the base), and loose ones for
forms that the strict patterns miss (spelled-out addresses, bracketed dots, national phone numbers, other separators).
Each candidate gets features of its format and of the text around it. Boosted trees, fitted on generated sentences with
known answers, score the loose candidates; a threshold for each kind, calibrated on templates of sentences that the
trees haven't seen, selects those that are reported besides the base.

All is done with DataFrame functions: matches come from regexp_extract_all, their places from the lengths of what split
leaves between them, summed in a window over one document's matches; trees become CASE expressions. Texts are never
shuffled, only matches are. Patterns are written so that Java's matcher needs neither recursion nor repeated scans of
long runs.

Defined results: a null or empty text has no spans; a null doc_id stays null; repeated rows give repeated rows; ends are
exclusive and count code points; an empty table gives an empty table; other columns are not carried.
"""

from __future__ import annotations

import random
from collections import Counter
from dataclasses import dataclass
from math import exp, log

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gneiss.llm.shared import read_table

KINDS = ("email", "ip", "card", "phone")
#: Left and right context, in code points.
LEFT, RIGHT = 32, 8
#: Generated sentences for each template, boosting rounds, learning rate and the precision that thresholds aim at.
SENTENCES, ROUNDS, RATE, PRECISION = 40, 24, 0.4, 0.97


@dataclass(frozen=True)
class Generator:
    name: str
    kind: str
    #: Java pattern.
    pattern: str
    #: A text without a match of this cheap test is not scanned.
    needs: str
    strict: bool = False


#: Equal to, in order: [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ ; [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+) ;
#: [0-9]([ -]?[0-9])+ ; \+[0-9][ ().0-9-]+[0-9] . A match begins where a run does or where the last match ended (\G), and
#: repeated groups are lazy runs up to the first place where the group can't go on.
GENERATORS = (
    Generator("email", "email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-][A-Za-z0-9.-]*?(?=\.(?![A-Za-z0-9-])|[^A-Za-z0-9.-]|\z)", "@", True),
    Generator("ip", "ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", True),
    Generator("card", "card", r"[0-9][ -]?[0-9][0-9 -]*?(?=[ -](?![0-9])|[^0-9 -]|\z)", "", True),
    Generator("phone", "phone", r"\+[0-9][ ().0-9-]+[0-9]", "+", True),
    Generator("email_spelled", "email", r"(?i)\b[a-z0-9][a-z0-9._%+-]{0,63} ?(?:\(at\)|\[at\]|\{at\}|<at>| at ) ?[a-z0-9-]{1,63}(?:(?: ?(?:\(dot\)|\[dot\]|\{dot\}|<dot>| dot ) ?|\.)[a-z0-9-]{2,24}){1,4}\b", ""),
    Generator("email_spaced", "email", r"(?i)\b[a-z0-9][a-z0-9._%+-]{0,63} ?@ ?[a-z0-9-]{1,63}(?: ?\. ?[a-z0-9-]{2,24}){1,4}\b", "@"),
    Generator("ip_bracketed", "ip", r"(?<![0-9.])[0-9]{1,3}(?: ?[\[(]\.[\])] ?[0-9]{1,3}){3}(?![0-9.])", "."),
    Generator("ip_six", "ip", r"(?i)(?<![0-9a-f:.])(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}(?![0-9a-f:])", ":"),
    Generator("card_dotted", "card", r"(?<![0-9./_])[0-9]{4}(?:[./_ ]{1,2}[0-9]{4}){3}(?![0-9])", ""),
    Generator("phone_bracketed", "phone", r"(?<![0-9+])(?:1[ .-]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])", "("),
    Generator("phone_national", "phone", r"(?<![0-9+(.-])(?:1[.-])?[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9.-])", ""),
    Generator("phone_prefixed", "phone", r"(?<![0-9+.])00[1-9][0-9]{0,2}(?:[ ./-][0-9]{2,4}){2,5}(?![0-9])", "00"),
)


_LINES = "array<struct<generator:int,value:string,gap:int,left:string,right:string,nth:int>>"


def _candidates(number: int, g: Generator) -> Column:
    """All matches of a generator in the column text, with what stands between them."""
    between, values = F.split(F.col("text"), g.pattern, -1), F.regexp_extract_all(F.col("text"), F.lit(g.pattern), F.lit(0))

    def before(value: Column, gap: Column) -> Column:
        # Most runs of digits are too short or too long for a card; only their lengths count.
        wanted = _digits(value).between(13, 19) if g.name == "card" else F.lit(True)
        return F.struct(F.lit(number).alias("generator"), value.alias("value"), F.length(gap).alias("gap"), F.when(wanted, F.right(gap, F.lit(LEFT))).alias("left"))

    def after(x: Column, gap: Column) -> Column:
        return x.withField("right", F.left(gap, F.lit(RIGHT)))

    lines = F.zip_with(values, F.slice(between, F.lit(1), F.size(values)), before)
    lines = F.zip_with(lines, F.slice(between, F.lit(2), F.size(values)), after)
    test = F.contains(F.col("text"), F.lit(g.needs)) if g.needs else F.lit(True)
    return F.when(test & F.rlike(F.col("text"), F.lit(g.pattern)), F.transform(lines, lambda x, i: x.withField("nth", i))).otherwise(F.array().cast(_LINES))


def located(docs: DataFrame) -> DataFrame:
    """doc_id, row (one value for each row of docs), and for each candidate generator, nth, value, start, end, left and
    right context; a row without candidates has one line of nulls."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("row", F.monotonically_increasing_id())
    found = F.concat(*(_candidates(i, g) for i, g in enumerate(GENERATORS)))
    rows = rows.select("doc_id", "row", F.explode_outer(found).alias("x")).select("doc_id", "row", "x.*")
    before = Window.partitionBy("row", "generator").orderBy("nth")
    start = F.sum(F.col("gap") + F.length("value")).over(before) - F.length("value")
    return rows.withColumn("start", start.cast("int")).withColumn("end", (F.col("start") + F.length("value")).cast("int")).drop("gap")


def _digits(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", ""))


def luhn(value: Column) -> Column:
    """Whether the digits of value pass the Luhn check."""
    digits = F.reverse(F.regexp_replace(value, "[^0-9]", ""))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.when(digits != "", F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0).otherwise(False)


#: A decimal number of at most 255, leading zeros allowed.
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def valid() -> Column:
    """Whether a strict candidate belongs to the base."""
    n = _digits(F.col("value"))
    name = F.col("generator")
    return (
        F.when(name == 0, True)
        .when(name == 1, F.rlike(F.col("value"), F.lit(rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$")))
        .when(name == 2, F.when(n.between(16, 19), luhn(F.col("value"))).otherwise(False))
        .when(name == 3, n.between(8, 15))
        .otherwise(False)
    )


def feature_columns() -> dict[str, Column]:
    """Features of a candidate, 0 or 1 each."""
    value, left, right = F.col("value"), F.lower(F.coalesce("left", F.lit(""))), F.coalesce("right", F.lit(""))
    n = _digits(value)
    says = lambda words: F.rlike(left, F.lit(rf"(?:{words})[^\n]{{0,12}}$"))
    found = {f"from_{g.name}": F.col("generator") == i for i, g in enumerate(GENERATORS) if not g.strict}
    found |= {
        "says_mail": says("e-?mail|mail|write|reach|contact|address|to:"),
        "says_phone": says("tel|phone|call|fax|mobile|cell|ring|dial|number is"),
        "says_card": says("card|visa|master|amex|pay|cvv|account|iban"),
        "says_ip": says(r"\bips?\b|server|host|login from|logged|addr|ping"),
        "says_other": says(r"version|ver\.|\bv|order|invoice|isbn|issn|ref|part|serial|build|section|figure|item|id|sku|ticket|chapter|page|score|ratio"),
        "money_before": F.rlike(left, F.lit("[$€£#=*/x-]\\s?$")),
        "joined_left": F.rlike(left, F.lit("[\\p{L}\\p{N}_]$")),
        "joined_right": F.rlike(right, F.lit("^[\\p{L}\\p{N}_%€$]")),
        "unit_after": F.rlike(right, F.lit("(?i)^\\s?(?:%|kg|km|mm|cm|px|ms|eur|usd|times|items)")),
        "luhn": luhn(value),
        "octets": F.rlike(F.regexp_replace(value, "[^0-9.]", ""), F.lit(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")),
        "known_tld": F.rlike(F.lower(value), F.lit("(?:^|[^a-z])(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$")),
        "spelled_marks": F.rlike(value, F.lit("[(\\[{<]")),
        "one_digit": n > 0,
        "all_same": F.rlike(F.regexp_replace(value, "[^0-9]", ""), F.lit("^([0-9])\\1*$")),
        "area_code": ~F.rlike(F.regexp_replace(value, "[^0-9]", ""), F.lit("^1?[01]")),
        "ten_digits": n.isin(10, 11),
        "mixed_marks": F.contains(value, F.lit(".")) & F.contains(value, F.lit("-")),
    }
    return {k: F.coalesce(c, F.lit(False)).cast("int") for k, c in found.items()}


def training_sentences(seed: int = 5, each: int = SENTENCES) -> list[tuple[str, int, bool]]:
    """Sentences with one loose candidate each, whether it is personal data, and whether its template is for calibration only.

    Every third template of each kind and label is kept from the fit, so thresholds rest on forms that trees haven't seen."""
    r = random.Random(seed)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("abcdefghiklmnoprstuvw") for _ in range(r.randint(3, 8)))
    tld = lambda: r.choice(["com", "org", "net", "de", "fr", "es", "io", "info"])
    area = lambda: r.choice("23456789") + d(2)
    octet = lambda: str(r.randint(0, 255))
    large = lambda: str(r.randint(256, 999))
    group = lambda: "%x" % r.randint(4096, 65535)

    def card():
        body = "4" + d(14)
        total = sum(x - 9 if x > 9 else x for x in (int(c) * (2 if i % 2 == 0 else 1) for i, c in enumerate(body)))
        return body + str(-total % 10)

    quads = lambda s, mark: mark.join(s[i : i + 4] for i in range(0, 16, 4))
    templates = {
        ("email", 1): [
            lambda: f"{r.choice(['write to', 'e-mail me:', 'contact', 'reach us,', word()])} {word()}.{word()} {r.choice(['(at)', '[at]', '(AT)'])} {word()} {r.choice(['(dot)', '[dot]'])} {tld()} {word()}",
            lambda: f"{r.choice(['write to', 'my mail is', 'contact'])} {word()} at {word()} dot {tld()}, {word()}",
            lambda: f"{r.choice(['schreiben Sie an', 'courriel :', 'correo:'])} {word()}_{word()}[at]{word()}.{tld()} {word()}",
            lambda: f"{r.choice(['mail', word()])} {word()}{d(2)} @ {word()}. {tld()} {word()}",
            lambda: f"{word()} <at> {word()} <dot> {tld()}",
            lambda: f"{r.choice(['address', 'to:', 'e-mail'])} {word()}.{word()} @ {word()}.{tld()}",
        ],
        ("email", 0): [
            lambda: f"{word()} {word()} at {word()}.{word()} {word()}",
            lambda: f"we met {word()} at {word()} dot {word()}{word()} again",
            lambda: f"look at {word()}.{word()} for {word()}",
            lambda: f"{d(2)} {word()} @ {word()}. {word().capitalize()} {word()}",
            lambda: f"sold {d(3)} @ {word()}. {word()} later",
            lambda: f"arrive at {word()} dot {word()}, {word()}",
        ],
        ("ip", 1): [
            lambda: f"{r.choice(['host', 'login from', 'server', word()])} {'[.]'.join(octet() for _ in range(4))} {word()}",
            lambda: f"{r.choice(['host', 'address', word()])} {':'.join(group() for _ in range(8))} {word()}",
            lambda: f"{r.choice(['ping', 'adresse', 'logged in from'])} {'(.)'.join(octet() for _ in range(4))}, {word()}",
        ],
        ("ip", 0): [
            lambda: f"{r.choice(['section', 'version', word()])} {'(.)'.join(large() for _ in range(4))} {word()}",
            lambda: f"{word()} {'[.]'.join([large(), *(octet() for _ in range(3))])} {word()}",
            lambda: f"{r.choice(['part', 'figure'])} {'[.]'.join([octet(), large(), large(), octet()])}",
        ],
        ("card", 1): [
            lambda: f"{r.choice(['card', 'visa', 'pay with', word()])} {quads(card(), r.choice(['.', '/', '_', '  ']))} {word()}",
            lambda: f"{word()} {quads(card(), '.')}",
            lambda: f"{r.choice(['Karte', 'carte', 'tarjeta'])} {quads(card(), '/')}, {word()}",
        ],
        ("card", 0): [
            lambda: f"{r.choice(['order', 'part', 'serial', 'ref', word()])} {quads('9' + d(14) + '1', r.choice(['.', '/', '_']))}{r.choice(['', ' kg', ' items'])}",
            lambda: f"{r.choice(['isbn', 'ticket', word()])} {quads('1' * 16, r.choice(['.', '_']))} {word()}",
            lambda: f"{r.choice(['id', 'sku', 'order'])} {quads('0' + d(14) + '3', '/')} {word()}",
        ],
        ("phone", 1): [
            lambda: f"{r.choice(['call', 'tel', 'phone', word()])} ({area()}) {area()}-{d(4)} {word()}",
            lambda: f"{r.choice(['call', 'tel', 'phone', 'cell', word()])} {area()}{(m := r.choice('.-'))}{area()}{m}{d(4)} {word()}",
            lambda: f"{r.choice(['mobile', 'Telefon', 'fax'])} ({area()}) {area()} {d(4)}, {word()}",
            lambda: f"{r.choice(['call', 'tel', 'fax', 'dial'])} 00{r.choice(['1', '49', '33', '34'])} {d(3)} {d(3)} {d(4)} {word()}",
            lambda: f"{word()} 1-{area()}-{area()}-{d(4)} {word()}",
            lambda: f"{r.choice(['tel', 'ring', 'number is'])} {area()}.{area()}.{d(4)}",
        ],
        ("phone", 0): [
            lambda: f"{r.choice(['item', 'part', 'order'])} ({r.choice('01') + d(2)}) {d(3)}-{d(4)} {word()}",
            lambda: f"{r.choice(['order', 'version', 'ticket', 'isbn', 'invoice #', '$'])} {r.choice('01') + d(2)}{r.choice('.-')}{d(3)}{r.choice('.-')}{d(4)}{r.choice(['', ' kg', '%'])}",
            lambda: f"{r.choice(['sku', 'ref', 'build'])} {area()}-{d(3)}-{d(4)} {word()}",
            lambda: f"{r.choice(['serial', 'order', 'part', 'item'])} 00{r.choice('123456789')}{d(2)}.{d(3)}.{d(3)} {word()}",
            lambda: f"{r.choice(['invoice', 'id', 'score'])} {area()}.{d(3)}.{d(4)}{r.choice([' kg', '%', ' eur'])}",
            lambda: f"{word()} {r.choice('01') + d(2)}-{d(3)}-{d(4)} {word()}",
        ],
    }
    return [(t(), label, i % 3 == 2) for (_, label), own in templates.items() for i, t in enumerate(own) for _ in range(each)]


@dataclass
class Trees:
    """Boosted trees of depth two over 0/1 features: (rounds of (feature, (feature, low, high) without it, the same with it)), a bias and thresholds by kind."""

    bias: float
    rounds: list[tuple]
    thresholds: dict[str, float]

    def score(self, row: dict[str, int]) -> float:
        total = self.bias
        for feature, *sides in self.rounds:
            inner, low, high = sides[row[feature]]
            total += high if row[inner] else low
        return total

    def column(self, features: dict[str, Column]) -> Column:
        total = F.lit(self.bias)
        for feature, *sides in self.rounds:
            leaf = [F.when(F.col(inner) == 1, high).otherwise(low) for inner, low, high in sides]
            total = total + F.when(F.col(feature) == 1, leaf[1]).otherwise(leaf[0])
        return total


def boost(rows: list[dict[str, int]], labels: list[int], kinds: list[str], apart: list[bool], rounds: int = ROUNDS, rate: float = RATE) -> Trees:
    """Newton boosting on log loss over the rows not set apart; thresholds on Platt-scaled scores of those set apart."""
    held = [i for i, x in enumerate(apart) if x]
    names = sorted(rows[0])
    # Rows alike in features and label are one, with a weight.
    weights = Counter((tuple(rows[i][f] for f in names), labels[i]) for i in range(len(rows)) if not apart[i])
    fit = sorted(weights)
    total = sum(weights.values())
    share = sum(n for (_, label), n in weights.items() if label) / total
    scores = dict.fromkeys(fit, log(share / (1 - share)))
    model = Trees(log(share / (1 - share)), [], {})

    def split(members, g, h):
        """The best feature among members, with the gain and the leaf values without and with it."""
        best = None
        for f in range(len(names)):
            sums = [[0.0, 1.0], [0.0, 1.0]]
            for x in members:
                side = sums[x[0][f]]
                side[0] += g[x]
                side[1] += h[x]
            gain = sum(x * x / y for x, y in sums)
            if best is None or gain > best[0] + 1e-12:
                best = gain, f, *(-rate * x / y for x, y in sums)
        return best

    for _ in range(rounds):
        p = {x: 1 / (1 + exp(-s)) for x, s in scores.items()}
        g, h = {x: weights[x] * (p[x] - x[1]) for x in fit}, {x: weights[x] * p[x] * (1 - p[x]) for x in fit}
        tried = []
        for f in range(len(names)):
            sides = [[x for x in fit if x[0][f] == v] for v in (0, 1)]
            if all(sides):
                inner = [split(side, g, h) for side in sides]
                tried.append((sum(x[0] for x in inner), f, [x[1:] for x in inner]))
        if not tried:
            break
        _, f, inner = max(tried, key=lambda t: (t[0], t[1]))
        model.rounds.append((names[f], *((names[x], low, high) for x, low, high in inner)))
        for x in fit:
            y, low, high = inner[x[0][f]]
            scores[x] += high if x[0][y] else low
    slope, shift = _platt([model.score(rows[i]) for i in held], [labels[i] for i in held])
    for kind in KINDS:
        own = sorted(((slope * model.score(rows[i]) + shift, labels[i]) for i in held if kinds[i] == kind), reverse=True)
        model.thresholds[kind] = _threshold(own)
    # The trees' own scale is kept; thresholds are taken back from the calibrated one.
    model.thresholds = {k: (t - shift) / slope for k, t in model.thresholds.items()}
    return model


def _platt(scores: list[float], labels: list[int]) -> tuple[float, float]:
    a, b = 1.0, 0.0
    for _ in range(300):
        grad = [(1 / (1 + exp(-min(max(a * s + b, -30), 30))) - t) for s, t in zip(scores, labels, strict=True)]
        a -= 0.05 * sum(x * s for x, s in zip(grad, scores, strict=True)) / len(scores)
        b -= 0.05 * sum(grad) / len(scores)
    return max(a, 0.05), b


def _threshold(own: list[tuple[float, int]], precision: float = PRECISION) -> float:
    """The lowest calibrated score, of 0 (an even chance) or more, above which precision holds."""
    best, right = 9.0, 0
    for i, (score, label) in enumerate(own):
        right += label
        if score >= 0 and right / (i + 1) >= precision and (i + 1 == len(own) or own[i + 1][0] < score):
            best = score
    return best - 1e-6


def train(spark: SparkSession) -> Trees:
    """Fits the trees on the generated sentences, which pass through the same generators and features as texts do."""
    sentences = training_sentences()
    frame = spark.createDataFrame([(i, s) for i, (s, _, _) in enumerate(sentences)], "doc_id long, text string").coalesce(1)
    features = feature_columns()
    strict = sum(g.strict for g in GENERATORS)
    found = located(frame).filter(F.col("generator") >= strict).select("doc_id", "generator", *(c.alias(k) for k, c in features.items())).orderBy("doc_id", "generator").collect()
    return boost([{k: r[k] for k in features} for r in found], [sentences[r["doc_id"]][1] for r in found], [GENERATORS[r["generator"]].kind for r in found], [sentences[r["doc_id"]][2] for r in found])


def _without_overlaps(loose: Column) -> Column:
    """Of loose spans in the order of kind and start, those that begin where the last one taken of their kind has ended."""
    empty = F.struct(F.array().cast(_SPANS).alias("taken"), F.lit(-1).alias("place"), F.lit(-1).alias("end"))

    def take(found: Column, x: Column) -> Column:
        free = (x["place"] != found["place"]) | (x["start"] >= found["end"])
        return F.when(free, F.struct(F.concat(found["taken"], F.array(x)).alias("taken"), x["place"].alias("place"), x["end"].alias("end"))).otherwise(found)

    return F.aggregate(loose, empty, take, lambda found: found["taken"])


_SPANS = "array<struct<place:int,start:int,end:int,kind:string,base:boolean,value:string,score:double>>"


def span_lists(docs: DataFrame, model: Trees | None = None) -> DataFrame:
    """doc_id, row and spans (an array in the order of kind and start) of each row of docs.

    Spans of the base all stay. A loose span goes where it overlaps one of the base or a loose one that was taken before
    it, of its own kind; spans of different kinds may overlap."""
    model = model or train(docs.sparkSession)
    strict = [i for i, g in enumerate(GENERATORS) if g.strict]
    of_kind = F.element_at(F.array(*(F.lit(g.kind) for g in GENERATORS)), F.col("generator") + 1)
    limit = F.element_at(F.create_map(*(F.lit(x) for k in KINDS for x in (k, float(model.thresholds[k])))), F.col("kind"))
    features = feature_columns()
    rows = located(docs).withColumn("kind", of_kind).withColumn("base", F.coalesce(valid(), F.lit(False)))
    loose = ~F.col("generator").isin(strict)
    scored = rows.withColumns({k: F.when(loose, c) for k, c in features.items()}).withColumn("score", F.when(loose, model.column(features))).drop(*features)
    # A loose span goes where it overlaps one of the base of its kind.
    order = Window.partitionBy("row", "kind").orderBy("start", F.desc("base"), "generator")
    back = Window.partitionBy("row", "kind").orderBy(F.desc("start"), "base", F.desc("generator"))
    earlier, later = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (order, back))
    covered = (F.coalesce(F.max(F.when(F.col("base"), F.col("end"))).over(earlier), F.lit(-1)) > F.col("start")) | (F.coalesce(F.min(F.when(F.col("base"), F.col("start"))).over(later), F.lit(1 << 30)) < F.col("end"))
    chosen = scored.withColumn("taken", F.coalesce(F.col("base") | ((F.col("score") >= limit) & ~covered), F.lit(False)))
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int").alias("place")
    span = F.when(F.col("taken"), F.struct(place, "start", "end", "kind", "base", "value", "score"))
    grouped = chosen.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(span)).cast(_SPANS).alias("every"))
    apart = [F.filter("every", lambda x: x["base"]), F.filter("every", lambda x: ~x["base"])]
    spans = F.when(F.size(apart[1]) == 0, apart[0]).otherwise(F.array_sort(F.concat(apart[0], _without_overlaps(apart[1]))))
    return grouped.select("doc_id", "row", spans.alias("spans"))


def find_spans(docs: DataFrame, model: Trees | None = None) -> DataFrame:
    """doc_id, row, kind, start, end, value, base and score of each span reported; one line of nulls for rows without any."""
    found = span_lists(docs, model).select("doc_id", "row", F.explode_outer("spans").alias("x"))
    return found.select("doc_id", "row", *(f"x.{c}" for c in ("kind", "start", "end", "value", "base", "score")))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = span_lists(read_table(spark, sf_dir, "documents")).withColumn("base", F.filter("spans", lambda x: x["base"]))
    kinds = F.transform("base", lambda x: x["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    joined = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


QUERIES = {"op1_pii": op1_pii}
ORACLE_SQL: dict[str, str] = {}
