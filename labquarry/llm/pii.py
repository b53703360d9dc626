"""Personal data by candidate gradient boosting, in DataFrame functions only.

Generators with high recall propose spans that may overlap: the four base patterns, looser forms of them (digit
groups with other separators, local phone numbers, e-mail addresses with spelt-out, bracketed or spaced signs), and long
tokens that may be secrets (keys, passwords). Boosted trees score each candidate by its format and its context on both
sides. The trees are taught by written forms set into contexts of the corpus's own texts; thresholds are calibrated on
forms that the trees have not seen. Of overlapping candidates the one with the higher score is selected. Spans of the
base patterns that pass their checks are scored too but always kept: the trees only add to them.

Matches are found by cutting a text at the pattern: the pieces between matches and the matches, interleaved, give each
match's place in code points. The patterns never go back over what they have read (possessive, and entered only where
a run begins or the last match ended), so that time stays linear in the text.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial, reduce
from operator import or_

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_stored, read, stored

KINDS = ("email", "ip", "card", "phone")

# The base patterns. Each matches exactly where the plain one does:
# email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+, ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+),
# card [0-9]([\x20-]?[0-9])+ (here only if it has the 14 digits that its check asks for), phone \+[0-9][\x20().0-9-]+[0-9].
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that a text must pass to be searched at all: one of these parts (to LIKE) is in it.
GUARD = {"email": ("%@%",), "ip": ("%.%",), "card": ("%",), "phone": ("%+%",)}

#: A further kind, which no base pattern finds.
SECRET = "secret"
PROPOSED = (*KINDS, SECRET)

# What may stand for the kind in writing that avoids or varies the plain form; the trees decide. Runs are matched whole, of any
# length; only the features that describe them are bounded.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?[\[(]\x20?(?:at|AT|@)\x20?[\])]\x20?|\x20@\x20|\x20AT\x20|\x20at\x20(?=[A-Za-z0-9-]++\x20(?:dot|DOT)\x20))"
    r"[A-Za-z0-9-]++(?:(?:\x20?[\[(]\x20?(?:dot|DOT|\.)\x20?[\])]\x20?|\x20(?:dot|DOT|\.)\x20|\.)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:(?:\x20?(?:\[\.\]|\(\.\))\x20?|\x20\.\x20)[0-9]{1,3}+){3}+(?![0-9.])",
    "card": r"(?<![0-9.])(?:[0-9]{4}(?:[.\x20/_-]{1,3}+[0-9]{4}){2}[.\x20/_-]{1,3}+[0-9]{2,4}+|[0-9]{4}[.\x20/_-][0-9]{6}[.\x20/_-][0-9]{5})(?![0-9.])",
    "phone": r"(?<![0-9+.-])(?:\(?[0-9]{3}\)?[\x20.-]{1,2}+[0-9]{3}[\x20.-][0-9]{4}|0[0-9]{2,4}+\x20?[/-]\x20?[0-9]{3}\x20?[0-9]{3,5}+|00[0-9]{2}(?:[\x20.-]?[0-9]{2,4}+){3,4}+)(?![0-9.-])",
    SECRET: r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{16,}+={0,2}+",
}
LOOSE_GUARD = {"email": ("%[%", "%(%", "% @ %", "% AT %", "% dot %", "% DOT %"), "ip": ("%[.]%", "%(.)%", "% . %"), "card": ("%",), "phone": ("%",), SECRET: ("%",)}
#: Words beside a candidate that speak for its kind, and those that speak against any.
_CONTEXT = {
    "email": r"(?i)(e-?mail|contact|write|reach|address|correo|courriel)",
    "ip": r"(?i)(\bip\b|host|server|address|client|login)",
    "card": r"(?i)(card|visa|master|payment|paid|tarjeta|carte|karte)",
    "phone": r"(?i)(phone|call|tel|mobile|cell|fax|anruf|appel|llam)",
    SECRET: r"(?i)(token|secret|key|passw|pwd|credential|bearer|auth|contrase|mot de passe|kennwort)",
}
_AGAINST = r"(?i)(order|invoice|\bpart\b|\bsum\b|isbn|\bref\b|serial|\bno\.|commit|sha-?[0-9]|checksum|md5|digest|etag|version|build|uuid)"
FEATURES = [
    "f_length", "f_digits", "f_letters", "f_groups", "f_separators", "f_luhn", "f_octets", "f_hex", "f_mixed", "f_domain", "f_word", "f_against", "f_assigned",
    "f_quoted", "f_left_digit", "f_right_digit", "f_loose", *(f"f_{k}" for k in PROPOSED),
]

TREES, DEPTH = 8, 4
#: Share of held-out candidates picked that must be right.
PRECISION = 0.98
#: Code points of context on each side.
CONTEXT = 48


_SPAN = "array<struct<start:int,end:int,what:string,left:string,right:string>>"


def matches(text: Column, pattern: str, keep: Callable[[Column], Column]) -> Column:
    """array<struct<start, end, what, left, right>> of those of the pattern's leftmost, non-overlapping matches that keep() takes.

    start and end are code points, end exclusive; left and right are up to CONTEXT code points around the match, as far as the matches beside it.
    """
    what = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    pairs = F.zip_with(F.zip_with(what, F.slice(between, F.lit(1), F.size(what)), lambda w, g: F.struct(w.alias("what"), g.alias("gap"))), F.slice(between, F.lit(2), F.size(what)), lambda p, n: F.struct(p["what"].alias("what"), p["gap"].alias("gap"), n.alias("next")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("found"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["what"])
        hit = F.struct(start.alias("start"), end.alias("end"), x["what"].alias("what"), F.right(x["gap"], F.lit(CONTEXT)).alias("left"), F.substring(x["next"], 1, CONTEXT).alias("right"))
        return F.struct(end.alias("at"), F.when(keep(x["what"]), F.concat(state["found"], F.array(hit))).otherwise(state["found"]).alias("found"))

    return F.aggregate(pairs, zero, step)["found"]


def digits(what: Column) -> Column:
    return F.regexp_replace(what, r"[^0-9]", "")


#: What a doubled digit adds in the Luhn check.
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def _luhn_sum(number: Column, doubled: int) -> Column:
    """Sum over the digits from the right, those at places doubled, doubled + 2, ... (from 0) counted twice, less 9 if over 9."""
    each = F.filter(F.split(F.reverse(number), ""), lambda d: d != "")
    twice = F.array(*map(F.lit, _DOUBLED))
    each = F.transform(each, lambda d, i: F.when(i % 2 == doubled, F.element_at(twice, d.cast("int") + 1)).otherwise(d.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def luhn(number: Column) -> Column:
    """Whether a string of at most 19 digits passes the Luhn check."""
    return F.when(F.length(number).between(1, 19), _luhn_sum(number, 1) % 10 == 0).otherwise(F.lit(False))


def passes(kind: str, what: Column) -> Column:
    """The base pattern's check of its match."""
    n = F.length(digits(what))
    part = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{0,2})"
    if kind == "ip":
        return what.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return n.between(14, 19) & luhn(digits(what))
    return n.between(10, 15) if kind == "phone" else F.lit(True)


def _found(text: Column, pattern: str, guard: Column, keep: Callable[[Column], Column]) -> Column:
    return F.when(guard & text.rlike(pattern), matches(text, pattern, keep)).otherwise(F.array().cast(_SPAN))


def _guard(text: Column, kind: str, likes: tuple[str, ...]) -> Column:
    some = reduce(or_, map(text.like, likes))
    return some if kind == "email" else some & text.rlike("[0-9]")


def features(x, word: Column, kinds: list[Column], loose: Column) -> Column:
    """Format and context of a candidate (what, left, right) as an array of numbers, in the order of FEATURES.

    word: whether its context speaks for its kind; kinds: which of PROPOSED it is. What is counted stays bounded.
    """
    what, number, left = x["what"], digits(x["what"]), x["left"]
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    upto = lambda c, n: F.least(c, F.lit(n)).cast("double")
    octet = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
    return F.array(
        upto(F.length(what), 200),
        upto(F.length(number), 200),
        upto(F.length(F.regexp_replace(what, r"[^A-Za-z]", "")), 200),
        upto(F.size(F.split(what, r"[^0-9A-Za-z]+")), 50),
        upto(F.length(F.regexp_replace(what, r"[0-9A-Za-z]", "")), 50),
        yes(luhn(number)),
        yes(what.rlike(rf"^{octet}(?:[^0-9]+{octet}){{3}}$")),
        yes(what.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)$")),
        yes(what.rlike(r"[a-z]") & what.rlike(r"[A-Z]") & what.rlike(r"[0-9]")),
        yes(what.rlike(r"(?:\.|[Dd][Oo][Tt]|[\])])\x20?[A-Za-z]{2,6}$")),
        yes(word),
        yes(left.rlike(_AGAINST)),
        yes(left.rlike(r"""[=:]\x20?["']?$""")),
        yes(left.rlike(r"""["'`]$""")),
        yes(left.rlike(r"[0-9][.,-]?$")),
        yes(x["right"].rlike(r"^[.,-]?[0-9]")),
        yes(loose),
        *map(yes, kinds),
    )


def _near(x, kind: str) -> Column:
    """Whether words that speak for the kind stand close by: just before, or soon after."""
    return F.right(x["left"], F.lit(24)).rlike(_CONTEXT[kind]) | F.substring(x["right"], 1, 24).rlike(_CONTEXT[kind])


def _near_own(x, kind: Column) -> Column:
    return reduce(lambda c, k: c.when(kind == k, _near(x, k)), PROPOSED, F.when(F.lit(False), F.lit(False)))


#: Labelled candidates made by rule, of each form; contexts of the corpus's own texts that they are set into, at most.
EXAMPLES = 150
CONTEXTS = 400


def contexts(docs: DataFrame, bound: int = CONTEXTS) -> DataFrame:
    """(place, before, after): places in at most `bound` texts, chosen by hash, with nothing like personal data around them."""
    text, h = F.col("text"), F.xxhash64("text")
    around = F.substring(text, (F.pmod(h, F.greatest(F.length(text) - 2 * CONTEXT, F.lit(1)).cast("long")) + 1).cast("int"), F.lit(2 * CONTEXT))
    some = docs.select("text").where(F.length("text") >= 2 * CONTEXT).select(h.alias("h"), around.alias("around"))
    some = some.where(~F.col("around").rlike(r"[0-9@=\[\]()+]")).distinct().orderBy("h", "around").limit(bound)
    numbered = some.withColumn("place", F.row_number().over(Window.orderBy("h", "around")) - 1)  # `bound` rows
    return numbered.select("place", F.concat(F.substring("around", 1, CONTEXT), F.lit(" ")).alias("before"), F.concat(F.lit(" "), F.substring("around", CONTEXT + 1, CONTEXT)).alias("after"))


def examples(spark: SparkSession, docs: DataFrame | None = None, n: int = EXAMPLES) -> DataFrame:
    """(what, left, right, kind, loose, label, unseen): made-up personal data and look-alikes in contexts of docs (text).

    Rows with `unseen` are of forms that are kept for calibration. The number of rows is fixed by n.
    """
    at = lambda k, m: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(m))
    d = lambda k, w: F.lpad(at(k, 10**w).cast("string"), w, "0")
    one = lambda k, some: F.element_at(F.array(*map(F.lit, some)), (at(k, len(some)) + 1).cast("int"))
    cat = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in xs))
    name = cat(one(1, ("ann", "li.wei", "j_ruiz", "omar", "kim", "sales", "b-ortiz")), one(2, ("", "7", "42", "1987")))
    host = cat(one(3, ("mail", "post", "corp-", "web")), one(4, ("", "3", "box")))
    tld = one(5, ("com", "org", "net", "de", "co", "example.com"))
    octets = [at(10 + k, 256).cast("string") for k in range(4)]
    high = [(at(10, 700) + 256).cast("string"), *octets[1:]]
    body = cat("4", d(14, 8), d(15, 6))
    check = F.pmod(10 - _luhn_sum(body, 0) % 10, F.lit(10))
    card = cat(body, check.cast("string"))
    wrong = cat(body, F.pmod(check + 1 + at(16, 9), F.lit(10)).cast("string"))
    fours = lambda c, sep: F.concat_ws(sep, *(F.substring(c, k, 4) for k in (1, 5, 9, 13)))
    local = lambda sep: F.concat_ws(sep, d(17, 3), d(18, 3), d(19, 4))
    hexes = lambda w: F.substring(F.sha2(F.col("id").cast("string"), 512), 1, w)
    base62 = lambda w: F.substring(F.translate(F.base64(F.unhex(F.sha2(F.col("id").cast("string"), 512))), "+/=", "x7q"), 1, w)
    either = lambda a, b: F.when(at(20, 2) == 0, a).otherwise(b)
    word = one(21, ("stay", "look", "meet", "arrive", "laugh"))
    other = one(22, ("home", "noon", "once", "work", "sea"))
    mail, tel, pay = ("write to ", "e-mail ", "contact: ", "", ""), ("call me on ", "phone: ", "tel. ", "mobile ", "fax "), ("card ", "paid by ", "visa ", "")
    counted = ("order ", "invoice no. ", "part ", "the sum of ", "isbn ", "ref ", "serial ")
    keyed = ('token = "', 'TOKEN = "', "api_key: ", "secret='", "password=", "Bearer ", 'auth "', "key = ")
    digest = ("commit ", "sha1 ", "checksum ", "md5: ", "digest ", "etag ", "build ", "")
    plain = ("",)
    forms = [  # kind, label, kept for calibration, loose, words before, what
        ("email", 1, 0, False, mail, cat(name, "@", host, ".", tld)),
        ("email", 1, 0, True, mail, cat(name, " [at] ", host, " [dot] ", tld)),
        ("email", 1, 0, True, mail, cat(name, "(at)", host, ".", tld)),
        ("email", 1, 0, True, mail, cat(name, " at ", host, " dot ", tld)),
        ("email", 0, 0, True, plain, cat(word, " (at) ", other, ".", d(6, 2))),
        ("email", 0, 0, True, plain, cat(d(6, 1), " @ ", d(7, 1), ".", d(8, 2))),
        ("email", 1, 1, True, mail, cat(name, " @ ", host, " . ", tld)),
        ("email", 1, 1, True, mail, cat(name, " AT ", host, " DOT ", tld)),
        ("email", 0, 1, True, plain, cat(word, " [at] ", d(7, 2), ".", d(8, 2))),
        ("ip", 1, 0, False, plain, F.concat_ws(".", *octets)),
        ("ip", 1, 0, True, plain, F.concat_ws("[.]", *octets)),
        ("ip", 0, 0, False, plain, F.concat_ws(".", *high)),
        ("ip", 0, 0, True, plain, F.concat_ws("[.]", *high)),
        ("ip", 1, 1, True, plain, F.concat_ws(" . ", *octets)),
        ("ip", 1, 1, True, plain, F.concat_ws("(.)", *octets)),
        ("ip", 0, 1, True, plain, F.concat_ws("(.)", *high)),
        ("card", 1, 0, False, pay, either(card, fours(card, " "))),
        ("card", 0, 0, False, (*pay, *counted), either(wrong, fours(wrong, " "))),
        ("card", 1, 0, True, pay, either(fours(card, "."), fours(card, "/"))),
        ("card", 0, 0, True, (*pay, *counted), either(fours(wrong, "."), fours(wrong, "/"))),
        ("card", 1, 1, True, pay, either(fours(card, " - "), fours(card, "_"))),
        ("card", 0, 1, True, (*pay, *counted), either(fours(wrong, " - "), fours(wrong, "_"))),
        ("phone", 1, 0, False, (*tel, ""), cat("+1 (", d(17, 3), ") ", d(18, 3), "-", d(19, 4))),
        ("phone", 0, 0, False, plain, cat("+", d(17, 3), "..", d(18, 2))),
        ("phone", 1, 0, True, tel, either(local("-"), local("."))),
        ("phone", 1, 0, True, (*tel, ""), cat("(", d(17, 3), ") ", d(18, 3), "-", d(19, 4))),
        ("phone", 1, 0, True, tel, cat("00", F.lit("49"), " ", d(17, 2), " ", d(18, 4), " ", d(19, 4))),
        ("phone", 0, 0, True, counted, either(local("-"), local(" "))),
        ("phone", 0, 0, True, counted, cat("0", d(17, 3), "/", d(18, 3), d(19, 4))),
        ("phone", 1, 1, True, tel, either(local(" "), cat("0", d(17, 3), " / ", d(18, 3), " ", d(19, 4)))),
        ("phone", 0, 1, True, counted, either(local("."), cat("0", d(17, 3), "-", d(18, 3), d(19, 4)))),
        (SECRET, 1, 0, True, keyed, either(hexes(40), F.upper(hexes(40)))),
        (SECRET, 1, 0, True, keyed, either(base62(24), base62(40))),
        (SECRET, 1, 0, True, keyed, cat("sk-", base62(32), "7")),
        (SECRET, 0, 0, True, digest, either(hexes(40), F.upper(hexes(40)))),
        (SECRET, 0, 0, True, plain, cat("4", d(14, 8), d(15, 7))),
        (SECRET, 0, 0, True, (*counted, ""), cat(word, "-the-", other, "-in-", d(6, 4))),
        (SECRET, 0, 0, True, plain, cat("img/", word, "/", other, "_", d(6, 4), "_large")),
        (SECRET, 1, 1, True, keyed, either(cat("AKIA", F.upper(base62(16)), "7"), cat("ghp_", base62(36), "7"))),
        (SECRET, 1, 1, True, keyed, either(hexes(32), hexes(64))),
        (SECRET, 0, 1, True, digest, either(hexes(32), hexes(64))),
        (SECRET, 0, 1, True, plain, cat("report_", word, "_final_version_", d(6, 1))),
    ]
    form = F.expr(f"cast(id div {n} as int)")
    pick = lambda values: reduce(lambda c, kv: c.when(form == kv[0], kv[1]), enumerate(values), F.when(F.lit(False), values[0]))
    columns = {
        "what": pick([f[5] for f in forms]),
        "intro": pick([one(23, f[4]) for f in forms]),
        "kind": pick([F.lit(f[0]) for f in forms]),
        "label": pick([F.lit(f[1]) for f in forms]),
        "unseen": pick([F.lit(f[2] == 1) for f in forms]),
        "loose": pick([F.lit(f[3]) for f in forms]),
    }
    made = spark.range(n * len(forms)).withColumns(columns)
    around = stored(contexts(docs)) if docs is not None else spark.createDataFrame([], "place int, before string, after string")
    found = around.count()
    made = made.withColumn("place", F.pmod(F.xxhash64("id", F.lit(24)), F.lit(max(1, found))).cast("int")).join(F.broadcast(around), "place", "left")
    left = F.concat(F.coalesce("before", F.lit("and then ")), F.col("intro"))
    right = F.concat(F.when(F.right("intro", F.lit(1)).isin('"', "'"), F.right("intro", F.lit(1))).otherwise(F.lit("")), F.coalesce("after", F.lit(" and so on")))
    return made.select("id", "what", left.alias("left"), right.alias("right"), "kind", "loose", "label", "unseen")


# A split or a leaf of a fitted tree: (feature, threshold, left, right) or its value.
Node = tuple[int, float, "Node", "Node"] | float


def _node(n) -> Node:
    """A fitted tree's node and all below it."""
    if n.getClass().getSimpleName() == "LeafNode":
        return float(n.prediction())
    split = n.split()
    return (split.featureIndex(), float(split.threshold()), _node(n.leftChild()), _node(n.rightChild()))


def _value(node: Node, f: Column) -> Column:
    if isinstance(node, float):
        return F.lit(node)
    feature, threshold, left, right = node
    return F.when(F.element_at(f, feature + 1) <= threshold, _value(left, f)).otherwise(_value(right, f))


_FOUND = "array<struct<start:int,rank:int,end:int,kind:string,base:boolean,score:double>>"


_PLACE = ("start", "rank", "end", "kind", "base")


def candidates(text: Column) -> Column:
    """array<struct<start, rank, end, kind, base, what, left, right>> of what all generators propose."""
    out = []
    for rank, kind in enumerate(PROPOSED):
        for base in (True, False) if kind in BASE else (False,):
            pattern, guard = (BASE[kind], GUARD[kind]) if base else (LOOSE[kind], LOOSE_GUARD[kind])
            hits = _found(text, pattern, _guard(text, kind, guard), partial(passes, kind) if base else _always)
            out.append(F.transform(hits, partial(_candidate, rank, kind, base)))
    return F.concat(*out)


def _always(what: Column) -> Column:
    return F.lit(True)


def _candidate(rank: int, kind: str, base: bool, x: Column) -> Column:
    return F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"), F.lit(base).alias("base"), x["what"].alias("what"), x["left"].alias("left"), x["right"].alias("right"))


@dataclass
class SpanModel:
    """Boosted trees with their weights, and for each kind the score from which a candidate is redacted."""

    trees: list[tuple[float, Node]]
    thresholds: dict[str, float]

    def score(self, f: Column) -> Column:
        """The trees' probability of personal data, from an array of features: plain expressions, evaluated where the row is."""
        margin = F.lit(0.0)
        for weight, tree in self.trees:
            margin = margin + F.lit(weight) * _value(tree, f)
        return 1 / (1 + F.exp(-2 * margin))

    def spans(self, text: Column) -> Column:
        """array<struct<start, rank, end, kind, base, score>>: base matches that pass their checks, and looser candidates
        whose score reaches their kind's threshold; they may overlap."""
        with_f = F.transform(candidates(text), lambda x: F.struct(*(x[c].alias(c) for c in _PLACE), features(x, _near_own(x, x["kind"]), [x["kind"] == k for k in PROPOSED], ~x["base"]).alias("f")))
        scored = F.transform(with_f, lambda x: F.struct(*(x[c].alias(c) for c in _PLACE), self.score(x["f"]).alias("score")))
        least = lambda kind: reduce(lambda c, kv: c.when(kind == kv[0], kv[1]), self.thresholds.items(), F.when(F.lit(False), 2.0)).otherwise(2.0)
        return F.filter(scored, lambda x: x["base"] | (x["score"] >= least(x["kind"])))


def labelled_features(made: DataFrame) -> DataFrame:
    """(kind, label, unseen, f) of examples(): stored, as many rows as there are examples."""
    x = {c: F.col(c) for c in ("what", "left", "right")}
    f = features(x, _near_own(x, F.col("kind")), [F.col("kind") == k for k in PROPOSED], F.col("loose"))
    return stored(made.select("id", "kind", "label", "unseen", f.alias("f")))


def fit_trees(labelled: DataFrame, seed: int = 7):
    """(MLlib's model, the same as trees): fitted on the forms that are not kept for calibration."""
    rows = labelled.where("not unseen").orderBy("id").select(F.col("label").cast("double").alias("label"), *(F.col("f")[i].alias(n) for i, n in enumerate(FEATURES)))
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows.coalesce(1))
    fitted = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=seed, cacheNodeIds=False).fit(rows)
    java = fitted._java_obj
    return fitted, [(float(w), _node(t.rootNode())) for w, t in zip(java.treeWeights(), java.trees(), strict=True)]


def fit(spark: SparkSession, docs: DataFrame | None = None, seed: int = 7) -> SpanModel:
    """Trees fitted on made-up examples in contexts of docs (text); thresholds calibrated on forms they have not seen.

    A kind's threshold is the lowest score from which the share of personal data among its loose calibration candidates
    is at least PRECISION; a kind that never reaches that gets no spans but the base ones. The numbers of examples and of
    contexts are fixed, so that nothing here but one pass over docs grows with the corpus; the same seed and docs give
    the same model.
    """
    labelled = labelled_features(examples(spark, docs))
    _, trees = fit_trees(labelled, seed)
    model = SpanModel(trees, {})
    scores = labelled.where("unseen").select("kind", "label", F.round(model.score(F.col("f")), 3).alias("score"))
    scores = scores.groupBy("kind", "score").agg(F.sum("label").alias("good"), F.count(F.lit(1)).alias("n"))
    from_here = Window.partitionBy("kind").orderBy(F.desc("score"))
    steps = scores.withColumn("share", F.sum("good").over(from_here) / F.sum("n").over(from_here))
    least = steps.where(F.col("share") >= PRECISION).groupBy("kind").agg(F.min("score").alias("least")).collect()  # a row a kind
    drop_stored(labelled)
    return SpanModel(trees, {r["kind"]: max(0.5, r["least"] - 0.0005) for r in least})


def chosen(spans: Column) -> Column:
    """Of spans by start: all base ones, and of the others those that overlap no base span and no one with a higher score.

    One sweep: a candidate waits until it is clear that nothing better overlaps it.
    """
    one = _FOUND.removeprefix("array<").removesuffix(">")
    zero = F.struct(F.lit(None).cast(one).alias("wait"), F.lit(-1).alias("base_end"), F.array().cast(_FOUND).alias("out"))

    def step(state: Column, x: Column) -> Column:
        wait = state["wait"]
        meets = wait.isNotNull() & (x["start"] < wait["end"])
        kept = F.when(wait.isNull() | meets, state["out"]).otherwise(F.concat(state["out"], F.array(wait)))
        base = F.struct(
            F.lit(None).cast(one).alias("wait"),
            F.greatest(state["base_end"], x["end"]).alias("base_end"),
            F.concat(kept, F.array(x)).alias("out"),
        )
        better = F.when(meets & (wait["score"] >= x["score"]), wait).otherwise(x)
        free = F.struct(better.alias("wait"), state["base_end"].alias("base_end"), kept.alias("out"))
        return F.when(x["base"], base).when(x["start"] < state["base_end"], state).otherwise(free)

    return F.aggregate(spans, zero, step, lambda s: F.when(s["wait"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(s["wait"]))))


def found_spans(text: Column, model: SpanModel) -> Column:
    """array of struct(start, rank, end, kind, base, score), by start, then kind as listed, then end."""
    t = F.coalesce(text, F.lit(""))
    return F.array_sort(chosen(F.array_sort(model.spans(t))))


def with_spans(docs: DataFrame, model: SpanModel, text: str = "text", name: str = "spans") -> DataFrame:
    """docs with `name`: array of struct(start, rank, end, kind, base, score), by start, then kind as listed, then end.

    Spans of the base patterns that pass their checks all stay; looser candidates are added where the trees select
    them and no base span overlaps. Null and empty texts have no spans; very long ones are searched whole; an empty table
    stays empty; a column that is already called `name` is replaced. Everything happens within a row: nothing is
    shuffled, so copies, hot sources and repeated rows cost no more than others.
    """
    return docs.withColumn(name, found_spans(F.col(text), model))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by the first one's kind in brackets."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, x: Column) -> Column:
        out = F.concat(state["out"], F.substring(text, state["at"] + 1, x["start"] - state["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))
        clear = x["start"] >= state["at"]
        return F.struct(F.greatest(x["end"], state["at"]).alias("at"), F.when(clear, out).otherwise(state["out"]).alias("out"))

    done = F.aggregate(spans, zero, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def op9_candidate_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    docs = with_spans(docs, fit(spark, docs))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == kind))).cast("long").alias(f"n_{kind}")
    base = listed(F.filter("spans", lambda x: x["base"]))
    return docs.select("doc_id", *map(count, KINDS), F.sha2(base, 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redact_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: personal data in the texts is replaced by its kind; n_chars, where it is there, follows the text.

    Null and empty texts and those without personal data stay as they are, very long ones are searched whole, repeated
    rows are each redacted, an empty table stays empty, and columns of any other name are carried along.
    """
    own = {"text", "n_chars"} & set(docs.columns)
    boxed = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), found_spans(F.col("text"), fit(spark, docs)).alias("spans"))
    new = boxed.select("row", "spans", redact(F.col("row.text"), F.col("spans")).alias("text"))
    if "n_chars" in own:
        kind = dict(docs.dtypes)["n_chars"]
        new = new.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast(kind)).otherwise(F.col("row.n_chars")))
    return new.select(*(F.col(c) if c in own else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
