"""Personal data: e-mail addresses, IP addresses, card numbers and phone numbers, with DataFrame operations only.

1. Base spans. For each kind the leftmost matches of a pattern that don't overlap; those that fail the kind's check (octets,
   Luhn's sum, number of digits) are dropped.
2. Generators. Looser patterns propose further spans that may overlap each other: numbers inside longer runs of digits,
   phone numbers without a plus, obfuscated addresses, IPv6 and so on. Features of format and context (what stands
   before and after, words such as "call" nearby) are the bits of one number.
3. Boosted trees. A proposal that is itself a base match has its label from the base check, one away from all base matches
   of its kind counts as 0, and one strictly inside a failing match has none. Forms that no base rule can judge
   (obfuscated or Unicode addresses, IPv6, phone numbers without a plus) have models of their own, fitted to made-up labelled
   texts (`made_up`): such forms where they are meant, and look-alikes where they are not (part numbers, ratios, times). Labels are counted per
   kind, form and feature number over all rows, a table whose size the number of bits bounds; gradient boosting with trees of depth 2 is fitted
   to it on the driver, and per kind and form the threshold is the lowest at which PRECISION of the labels above are 1, and above
   which no margin has less; for made-up texts it is set on those that the trees weren't fitted to. Where there is nothing to tell apart, as all
   labels of a kind are 1, a proposal is accepted if it passes the kind's own check, and in no other case.
4. Selection. Base spans stay. A proposal joins them if its calibrated score passes and it overlaps no base span and no
   accepted proposal that starts before it (of several with one start, the longest counts).

Positions are code points. Matches are found by extracting all matches and splitting at them; positions are running
sums of lengths, taken in blocks, so that a text with very many matches stays cheap. Patterns use possessive
repetition and start only where a run starts: no backtracking, no recursion and no quadratic scan on long texts.

Null texts count as empty: no spans. Repeated rows get repeated results; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize, prepare, texts

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.99
_WORD = "[A-Za-z0-9._%+-]"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
BASE = {
    "email": rf"(?:\G|(?<!{_WORD})){_WORD}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    # Matches of [0-9]([\x20-]?[0-9])+ are the maximal runs; only those of 14 to 19 digits can be sound.
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A cheap test that any text with a match passes.
HINT = {"email": "%@%", "ip": "%.%.%.%", "card": "%", "phone": "%+%"}
GENERATORS = {
    "email": (
        rf"(?<!{_WORD}){_WORD}++\x20?(?:\(at\)|\[at\]|\{{at\}})\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\]|\{{dot\}})\x20?[A-Za-z0-9-]++)++",
        r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]++@[\p{L}0-9-]++(?:\.[\p{L}0-9-]++)++",
    ),
    "ip": (
        r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Za-z:])",
        rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9])",
    ),
    "card": (
        r"(?<![0-9])[0-9]{13,19}(?![0-9])",
        r"(?<![0-9])(?:[0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}|3[47][0-9]{2}[\x20-][0-9]{6}[\x20-][0-9]{5})(?![0-9])",
    ),
    "phone": (
        r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])",
        r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    ),
}
# Words that speak for a kind, in the languages of the corpora this was made for.
CONTEXT = {
    "email": r"(?i)\b(?:(?:e-?)?mail|contact|write|schreib|correo|courriel)",
    "ip": r"(?i)\b(?:ip|host|server|address|adresse)\b",
    "card": r"(?i)\b(?:card|visa|credit|karte|tarjeta|carte)\b",
    "phone": r"(?i)\b(?:phone|call|tel|fax|mobile|telefon|llame|appel)",
}
# What makes a form speak for itself: dots in words, hexadecimal digits or long groups, an area code in brackets.
TELLING = {"email": r"(?i)[(\[{]dot[)\]}]|@", "ip": r"[A-Fa-f]|[0-9]{3}", "card": r"^\b$", "phone": r"^\("}
# Words right before a number that make it something else.
OTHERWISE = r"(?i)\b(?:no|nos|nr|num|number|part|ratio|table|order|item|id|isbn|version|page|code|ref|art|serial|score|model|lot|batch|sku|case|section|invoice|account|value|time|line|row|nummer|teil|seite|tabelle|pedido|tabla|valor|commande|tableau|valeur)\b[\s.:#=-]*$"
FEATURES = 10
BLOCK = 64


def _running(df: DataFrame, lengths: Column, name: str) -> DataFrame:
    """df with `name`: for each i the sum of lengths[0..i], by blocks. Bodies of lambdas only use their own variables and
    stored columns, as they are evaluated for each element."""
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v)
    df = df.withColumn("_lengths", lengths)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("_lengths") - 1) / BLOCK).cast("int")), lambda b: F.slice("_lengths", b * BLOCK + 1, BLOCK))
    df = df.withColumn("_blocks", blocks)
    before = F.aggregate("_blocks", F.array(F.lit(0).cast("long")), lambda a, block: F.concat(a, F.array(F.element_at(a, -1) + total(block))))
    pairs = F.arrays_zip(F.col("_blocks").alias("block"), F.slice(before, 1, F.size("_blocks")).alias("before"))
    sums = F.transform(pairs, lambda p: F.transform(F.sequence(F.lit(1), F.size(p["block"])), lambda i: p["before"] + total(F.slice(p["block"], 1, i))))
    return df.withColumn(name, F.flatten(sums)).drop("_lengths", "_blocks")


def matches(df: DataFrame, name: str, pattern: str, hint: str = "%") -> DataFrame:
    """df (text, ...) with the column `name`: an array of (start, stop, value, before, after) of the pattern's matches.
    before and after are the text up to the neighbouring matches, with the nearest character of these."""
    regex, empty = F.lit(pattern), F.array().cast("array<string>")
    maybe = F.col("text").like(hint)
    df = df.withColumn("_found", F.when(maybe, F.regexp_extract_all("text", regex, F.lit(0))).otherwise(empty))
    df = df.withColumn("_gaps", F.when(F.size("_found") > 0, F.split("text", pattern, -1)).otherwise(empty))
    df = _running(df, F.zip_with(F.slice("_gaps", 1, F.size("_found")), "_found", lambda g, v: F.char_length(g).cast("long") + F.char_length(v)), "_at")
    rows = F.transform(
        F.arrays_zip(
            F.col("_found").alias("value"), F.col("_at").alias("stop"), F.slice("_gaps", 1, F.size("_found")).alias("before"), F.slice(F.col("_gaps"), 2, F.size("_found")).alias("after"),
            F.concat(F.array(F.lit("")), F.slice("_found", 1, F.size("_found") - 1)).alias("previous"), F.concat(F.slice("_found", 2, F.size("_found")), F.array(F.lit(""))).alias("next"),
        ),
        lambda m: F.struct(
            (m["stop"] - F.char_length(m["value"])).cast("long").alias("start"), m["stop"].cast("long").alias("stop"), m["value"].alias("value"),
            F.right(F.concat(F.right(m["previous"], F.lit(1)), m["before"]), F.lit(40)).alias("before"),
            F.left(F.concat(m["after"], F.left(m["next"], F.lit(1))), F.lit(2)).alias("after"),
        ),
    )
    none = F.array().cast("array<struct<start:bigint,stop:bigint,value:string,before:string,after:string>>")
    return df.withColumn(name, F.when(F.size("_found") > 0, rows).otherwise(none)).drop("_found", "_gaps", "_at")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether Luhn's sum of a string of digits is divisible by ten."""
    one = lambda i: F.substring(digits, -i, F.lit(1)).cast("int") * (F.lit(2) - i % 2)
    total = F.aggregate(F.sequence(F.lit(1), F.greatest(F.char_length(digits), F.lit(1))), F.lit(0), lambda a, i: a + one(i) - F.when(one(i) > 9, 9).otherwise(0))
    return (F.char_length(digits) > 0) & (total % 10 == 0)


def sound(kind: str, value: Column) -> Column:
    """The kind's check of a base match."""
    n = F.char_length(_digits(value))
    if kind == "ip":
        return value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return n.between(14, 19) & F.when(n.between(14, 19), luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def features(kind: str, m: Column) -> Column:
    """The bits of format and context of a proposal."""
    value, n = m["value"], F.char_length(_digits(m["value"]))
    bits = [
        F.when(F.lit(kind == "card"), luhn(_digits(value))).otherwise(F.lit(False)),
        n.between(14, 19),
        n.between(10, 15),
        value.rlike(r"[\x20().-]"),
        F.lit(kind == "email") | value.rlike(r"^[\x00-\x7f]*$"),
        F.right(m["before"], F.lit(1)).rlike(r"[\p{L}0-9_./=#-]"),
        F.left(m["after"], F.lit(1)).rlike(r"[\p{L}0-9_/=#]"),
        m["before"].rlike(CONTEXT[kind]),
        value.rlike(TELLING[kind]),
        m["before"].rlike(OTHERWISE),
    ]
    assert len(bits) == FEATURES
    return sum((b.cast("int") * (1 << i) for i, b in enumerate(bits)), F.lit(0)).cast("int")


def _within_run(kind: str, m: Column) -> Column:
    """Whether a card proposal is part of a run of digits that is too long or short for a base match."""
    if kind != "card":
        return F.lit(False)
    return m["before"].rlike(r"[0-9][\x20-]?$") | m["after"].rlike(r"^[\x20-]?[0-9]")


def _unjudged(kind: str, value: Column) -> Column:
    """Whether a proposal has a form that no base match can have."""
    return {"email": ~value.rlike(r"^[\x00-\x7f]*@[\x00-\x7f]*$"), "ip": value.contains(":"), "phone": ~value.startswith("+")}.get(kind, F.lit(False))


def _over(spans: Column, m: Column) -> Column:
    return F.exists(spans, lambda s: (s["start"] < m["stop"]) & (m["start"] < s["stop"]))


def proposals(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text, ...) with base_{kind}: sound spans (start, stop), and more_{kind}: proposals (start, stop, bits, free,
    sound, label; free: of a form that no base rule judges) that overlap no base span of any kind, or, with a label, are one themselves."""
    for kind in KINDS:
        rows = matches(rows, f"all_{kind}", BASE[kind], HINT[kind])
        rows = rows.withColumn(f"all_{kind}", F.transform(f"all_{kind}", lambda m: F.struct(m["start"], m["stop"], sound(kind, m["value"]).alias("sound"))))
        for i, pattern in enumerate(GENERATORS[kind]):
            rows = matches(rows, f"gen_{kind}_{i}", pattern, "%at%" if (kind, i) == ("email", 0) else "%:%" if (kind, i) == ("ip", 0) else "%+%" if (kind, i) == ("phone", 0) else HINT[kind] if kind != "phone" else "%")
    for kind in KINDS:
        every = F.col(f"all_{kind}")
        labelled = F.transform(
            F.array_distinct(F.concat(*(f"gen_{kind}_{i}" for i in range(len(GENERATORS[kind]))))),
            lambda m: F.struct(
                m["start"], m["stop"], features(kind, m).alias("bits"), _unjudged(kind, m["value"]).alias("free"), sound(kind, m["value"]).alias("sound"),
                F.when(F.exists(every, lambda b: (b["start"] == m["start"]) & (b["stop"] == m["stop"]) & b["sound"]), 1)
                .when(F.exists(every, lambda b: (b["start"] == m["start"]) & (b["stop"] == m["stop"])), 0)
                .when(~_over(every, m) & ~_within_run(kind, m) & ~_unjudged(kind, m["value"]), 0).alias("label"),
            ),
        )
        rows = rows.withColumn(f"more_{kind}", labelled)
        rows = rows.withColumn(f"base_{kind}", F.transform(F.filter(every, lambda b: b["sound"]), lambda b: F.struct(b["start"], b["stop"])))
    return rows.drop(*(f"all_{k}" for k in KINDS), *(f"gen_{k}_{i}" for k in KINDS for i in range(len(GENERATORS[k]))))


def boost(table: list[tuple[int, int, int]], rounds: int = 30, rate: float = 0.3, pull: float = 1.0):
    """Trees (bit a, bit b, [values for neither, b, a, both]) that lower the logistic loss of (bits, zeros, ones) rows, and the
    start value. Each round takes the pair of bits with the largest gain."""
    zeros, ones = sum(r[1] for r in table), sum(r[2] for r in table)
    start = math.log((ones + 0.5) / (zeros + 0.5))
    margins = [start] * len(table)
    trees = []
    pairs = [(a, b) for a in range(FEATURES) for b in range(a + 1, FEATURES)]
    for _ in range(rounds):
        found = []
        for m, (_, zero, one) in zip(margins, table, strict=True):
            p = 1 / (1 + math.exp(-m))
            found.append(((zero + one) * p - one, (zero + one) * p * (1 - p)))
        best = None
        for a, b in pairs:
            g, h = [0.0] * 4, [0.0] * 4
            for (bits, _, _), (gi, hi) in zip(table, found, strict=True):
                leaf = 2 * (bits >> a & 1) + (bits >> b & 1)
                g[leaf] += gi
                h[leaf] += hi
            gain = sum(x * x / (y + pull) for x, y in zip(g, h, strict=True))
            if best is None or gain > best[0] + 1e-12:
                best = gain, a, b, [-rate * x / (y + pull) for x, y in zip(g, h, strict=True)]
        _, a, b, values = best
        if max(map(abs, values)) < 1e-4:
            break
        trees.append((a, b, values))
        for i, (bits, _, _) in enumerate(table):
            margins[i] += values[2 * (bits >> a & 1) + (bits >> b & 1)]
    return start, trees, margins


def threshold(table, margins, precision: float = PRECISION) -> float | None:
    """The lowest margin at and above which at least this share of the labels is 1, at each margin and in all, so that few
    zeros among many ones don't open the margins where they lie."""
    lowest, zeros, ones = None, 0, 0
    counted = {}
    for m, (_, zero, one) in zip(margins, table, strict=True):
        z, o = counted.get(m, (0, 0))
        counted[m] = z + zero, o + one
    for m, (zero, one) in sorted(counted.items(), reverse=True):
        zeros, ones = zeros + zero, ones + one
        if zero + one and one / (zero + one) < precision:
            break
        if ones and ones / (zeros + ones) >= precision:
            lowest = m
    return lowest


def made_up() -> list[tuple[int, str, str, int]]:
    """(number, text, kind, label): forms that no base rule judges, in contexts where they are meant and where they aren't."""
    numbers = ["269-555-3296", "800 555 1234", "555.123.4567", "415-555-0199", "312 555 7788", "907.555.1010"]
    bracketed = ["(269) 555-3296", "(800) 555 1234", "(415) 555.0199"]
    calls = ["call {} now", "phone: {}", "tel. {}", "my mobile is {}", "fax {} please", "Telefon {}", "llame al {} hoy", "appelez-nous, tel {}", "phone us any time after six at {}", "Call me, {}"]
    plain = ["it says {} there", "{} after six", "then {}", "we saw {} again", "from {} on", "and {} too"]
    things = ["ratio {} in table", "part no {} is gone", "table {} shows it", "order {} was sent", "isbn {}", "item {} of the list", "page {}", "section {}", "serial {}", "invoice {} is due", "id: {}", "score {}", "lot {}", "Nummer {}", "valor {}"]
    rows = [(t, v, "phone", 1) for t in calls for v in numbers + bracketed] + [(t, v, "phone", 1) for t in plain for v in bracketed]
    rows += [(t, v, "phone", 0) for t in plain + things for v in numbers] + [(t, v, "phone", 0) for t in things for v in bracketed]
    hexes = ["2001:db8:0:0:0:ff00:42:8329", "fe80:0:0:0:1:2:3:4", "2001:0:0:1:0:0:0:25de", "fd00:1:2:3:4:5:6:7", "2606:4700:0:0:0:0:6810:84e5"]
    digits = ["1:2:3:4:5:6:7:8", "12:30:45:10:11:12:13:14", "9:8:7:6:5:4:3:2"]
    hosts = ["host {} is up", "server at {} answered", "ip {}", "its address is {}", "Server: {}"]
    rows += [(t, v, "ip", 1) for t in hosts for v in hexes + digits] + [(t, v, "ip", 1) for t in plain for v in hexes]
    rows += [(t, v, "ip", 0) for t in [*plain, "time {} is a list", "ratio {}", "line {}", "score {} so far"] for v in digits]
    dotted = ["jane (at) example (dot) org", "john.smith [at] mail [dot] example [dot] com", "info {at} firm {dot} de"]
    half = ["bob (at) example.com", "look (at) home.now", "meet (at) noon.today", "sales [at] shop.example"]
    unicode = ["jörg@exämple.de", "señor@correo.es", "élise@société.fr"]
    mails = ["mail {} now", "contact {}", "write to {} today", "email: {}", "e-mail {} please", "schreib an {}", "correo {}"]
    rows += [(t, v, "email", 1) for t in mails for v in dotted + half + unicode] + [(t, v, "email", 1) for t in plain for v in dotted + unicode]
    rows += [(t, v, "email", 0) for t in [*plain, "please {} for once", "they {} as well", "you {} or not"] for v in half]
    return [(i, t.format(v) if "{" not in v else t.replace("{}", v), kind, label) for i, (t, v, kind, label) in enumerate(rows)]


def margin(start: float, trees: list, bits: int) -> float:
    return start + sum(values[2 * (bits >> a & 1) + (bits >> b & 1)] for a, b, values in trees)


class Selector:
    """Per kind and form (free: no base rule judges it): trees and threshold, as an expression over a proposal."""

    def __init__(self, counted: list[tuple[str, int, int, int]], free: list[tuple[str, int, int, int, int]] = ()):
        """counted: (kind, bits, zeros, ones) by the base rules; free: (kind, bits, part, zeros, ones) of made-up texts, whose
        part 0 is fitted and part 1 sets the threshold."""
        self.models: dict[tuple[str, bool], tuple[float, list, float]] = {}
        self.checked: set[str] = set()
        for kind in KINDS:
            table = sorted(r[1:] for r in counted if r[0] == kind)
            if table and sum(r[2] for r in table):
                start, trees, margins = boost(table)
                if not sum(r[1] for r in table):  # nothing to tell apart
                    self.checked.add(kind)
                elif (lowest := threshold(table, margins)) is not None:
                    self.models[kind, False] = start, trees, lowest
            parts = [sorted((r[1], *r[3:]) for r in free if r[0] == kind and r[2] == part) for part in (0, 1)]
            if all(sum(r[i] for r in part) for part in parts for i in (1, 2)):
                start, trees, _ = boost(parts[0])
                if (lowest := threshold(parts[1], [margin(start, trees, r[0]) for r in parts[1]])) is not None:
                    self.models[kind, True] = start, trees, lowest

    def _passes(self, kind: str, free: bool, bits: Column) -> Column:
        start, trees, lowest = self.models[kind, free]
        total = F.lit(start)
        for a, b, values in trees:
            x, y = bits.bitwiseAND(1 << a) != 0, bits.bitwiseAND(1 << b) != 0
            total = total + F.when(x & y, values[3]).when(x, values[2]).when(y, values[1]).otherwise(values[0])
        return total >= lowest - 1e-9

    def accepts(self, kind: str, m: Column) -> Column:
        judged = m["sound"] if kind in self.checked else self._passes(kind, False, m["bits"]) if (kind, False) in self.models else F.lit(False)
        free = self._passes(kind, True, m["bits"]) if (kind, True) in self.models else F.lit(False)
        return F.when(m["free"], free).otherwise(judged)


def _counts(rows: DataFrame, *by: str) -> list[tuple]:
    zeros, ones = (F.count(F.when(F.col("label") == v, 1)).alias(n) for v, n in ((0, "zeros"), (1, "ones")))
    return [tuple(r) for r in rows.groupBy("kind", "bits", *by).agg(zeros, ones).collect()]  # kinds x 2 ** FEATURES rows, or twice that


def learn(rows: DataFrame) -> Selector:
    """Counts the labels of all proposals in rows, the result of proposals(), and those of the made-up texts, and fits the
    trees to the counts."""
    every = F.concat(*(F.transform(f"more_{k}", lambda m: F.struct(F.lit(k).alias("kind"), m["bits"].alias("bits"), m["free"].alias("free"), m["label"].alias("label"))) for k in KINDS))
    each = rows.select(F.explode(F.filter(every, lambda m: m["label"].isNotNull() & ~m["free"])).alias("m")).select("m.*")
    texts_of = proposals(rows.sparkSession.createDataFrame(made_up(), "doc_id long, text string, meant string, truth int"))
    part = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2).cast("int").alias("part")
    free = texts_of.select("meant", "truth", part, F.explode(F.filter(every, lambda m: m["free"])).alias("m")).where("m.kind = meant")
    return Selector(_counts(each), _counts(free.select("m.kind", "m.bits", "part", F.col("truth").alias("label")), "part"))


def select(rows: DataFrame, selector: Selector) -> DataFrame:
    """rows with `spans`: the base spans and the accepted proposals (start, place of the kind, stop), in order."""
    ordered = lambda prefix, keep: F.concat(*(
        F.transform(keep(k, F.col(f"{prefix}_{k}")), lambda m: F.struct(m["start"].alias("start"), F.lit(i).alias("kind"), m["stop"].alias("stop"))) for i, k in enumerate(KINDS)
    ))
    rows = rows.withColumn("base", F.array_sort(ordered("base", lambda _, spans: spans)))
    more = ordered("more", lambda k, spans: F.filter(spans, lambda m: selector.accepts(k, m)))
    rows = rows.withColumn("more", F.filter(more, lambda m: ~_over(F.col("base"), m)))
    none = F.array().cast("array<struct<start:bigint,kind:int,stop:bigint>>")
    # In order of start, longest first; what overlaps the last one kept goes.
    rows = rows.withColumn("more", F.array_sort(F.transform("more", lambda m: F.struct(m["start"].alias("start"), (-m["stop"]).alias("back"), m["kind"].alias("kind")))))
    chosen = F.aggregate(
        "more", none,
        lambda kept, m: F.when((F.size(kept) > 0) & (F.element_at(kept, F.when(F.size(kept) > 0, -1).otherwise(1))["stop"] > m["start"]), kept)
        .otherwise(F.concat(kept, F.array(F.struct(m["start"].alias("start"), m["kind"].alias("kind"), (-m["back"]).alias("stop"))))),
    )
    return rows.withColumn("spans", F.array_sort(F.concat(F.col("base").cast("array<struct<start:bigint,kind:int,stop:bigint>>"), F.when(F.size("more") > 0, chosen).otherwise(none))))


def find(docs: DataFrame, learn_from: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base_{kind} ..., base, spans) of each row; the trees are fitted to learn_from, else to docs. Proposals are
    written to the shared folder, without the texts: they are found once, counted, and selected from."""
    prepare(docs.sparkSession)
    rows = materialize(proposals(texts(docs, id_col, text_col)).drop("text"), "proposals")
    selector = learn(rows if learn_from is None else proposals(texts(learn_from, id_col, text_col)))
    return select(rows, selector)


def _joined(spans: str) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with each span of its texts replaced by its kind in brackets; null texts stay null. All columns stay."""
    names = docs.columns
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), F.lit(0).cast("long").alias("doc_id"))
    prepare(docs.sparkSession)
    rows = proposals(packed)  # found twice: keeping whole rows beside their proposals takes more memory than time
    rows = select(rows, learn(rows))
    marks = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    piece = lambda a, s: F.struct(
        F.greatest(a["at"], s["stop"]).alias("at"),
        F.when(s["start"] < a["at"], a["out"]).otherwise(F.concat(a["out"], F.substring(F.col("text"), (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.element_at(marks, s["kind"] + 1))).alias("out"),
    )
    done = F.aggregate("spans", start, piece, lambda a: F.concat(a["out"], F.substring(F.col("text"), (a["at"] + 1).cast("int"), F.char_length("text"))))
    new = F.when(F.size("spans") > 0, done).otherwise(F.col(f"row.`{text_col}`"))
    return rows.withColumn("new", new).select(*((F.col("new") if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in names))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(documents(spark, sf_dir))
    return found.select(
        "doc_id", *(F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"), _joined("spans").alias("spans"),
    )
