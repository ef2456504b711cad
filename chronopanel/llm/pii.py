"""Personal data: loose generators propose spans, boosted trees judge them, calibrated thresholds select.

*Base spans* (``email``, ``ip``, ``card``, ``phone``) follow fixed patterns and checks and always stay. *Candidates* come
from generators that also take spaced or bracketed addresses, bracketed dots and any grouping of seven or more digits;
they overlap one another and the base. Those that do not overlap a base span are scored by gradient boosted trees on
features of format (lengths, digits, groups, signs) and of context (the characters around, words that announce a kind).

*Training.* Candidates of all rows, fitted by MLlib on the cluster. Positive are those that
overlap a base span of their kind, and their variants: without the plus sign, with bracketed or spaced signs, in other
groups. Negative are those that overlap a base span of another kind or fail what their kind demands in any writing (bytes
above 255, check digits, fewer than ten digits, dates). All others look like personal data outside the base: they are
unknown and taught as neither. A fixed set of made-up examples of both labels and every kind (``prior``) goes along, so
tables of any size are learned from; only a table without any candidate has no judge. The plus sign and the check digit
are withheld from the trees: they have to tell by format and context. On half of the examples, kept out of the fit, every
kind gets the lowest threshold from which examples are right in at least ``precision`` of cases; as unknown ones are not
among them, this is a precision against sure negatives. Selected spans do not overlap: the likelier goes first, then the
earlier, then the kind listed first.

The main path is DataFrame functions throughout: matches are located by marking them in the text, cutting at the marks
and summing lengths. Positions are code points, ends exclusive. Null and empty texts have no spans. Repeated rows are
judged alike and each stays a row; empty tables give empty results; input columns come back inside the struct ``doc``.
Very long texts are searched whole.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopanel.llm.common import kept, let

KINDS = ("email", "ip", "card", "phone")

_MARK, _OTHER = "\ue000", "\ue001"
_GROUP = 64

# A match starts where the last one ended or where its first run of characters begins; starts inside a run cannot do
# better than the start of the run, and possessive runs keep the search linear in the text.
_LOCAL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++"
BASE = {
    "email": _LOCAL + r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": _LOCAL + r"(?:\x20?@\x20?|\x20?[(\[{]\x20?at\x20?[)\]}]\x20?)[A-Za-z0-9-]++"
    r"(?:(?:\.|\x20?[(\[{]\x20?dot\x20?[)\]}]\x20?)[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9.]))[0-9]{1,3}(?:\x20?(?:\[\.\]|\.)\x20?[0-9]{1,3}){3}(?![0-9])",
    "number": r"(?:\G|(?<![A-Za-z0-9]))[+(]?[0-9](?:[\x20()./-]{0,2}[0-9]){6,}+",
}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_HINTS = {
    "hint_mail": r"(?i)(mail|contact|write)[^A-Za-z]*$",
    "hint_ip": r"(?i)(ip|host|server|address|addr)[^A-Za-z]*$",
    "hint_card": r"(?i)(card|visa|credit|karte|carte|tarjeta)[^A-Za-z]*$",
    "hint_phone": r"(?i)(tel|phone|call|mobile|fax|mobil)[^A-Za-z]*$",
}
FEATURES = (
    "is_email is_ip is_card is_phone n digits letters blanks dashes dots brackets groups longest first_group last_group "
    "before_word after_word before_digit after_digit "
).split() + list(_HINTS)

Match = Callable[[Column], Column]


def _nothing() -> Column:
    return F.array().cast("array<struct<start: int, end: int, what: string, before: string, after: string>>")


def _cut(text: Column, pattern: str) -> Column:
    """The text in pieces, matches at odd places."""
    # the mark itself, should a text hold it, becomes another character that no pattern takes
    clean = F.when(F.contains(text, F.lit(_MARK)), F.translate(text, _MARK, _OTHER)).otherwise(text)
    return F.split(F.regexp_replace(clean, pattern, f"{_MARK}$0{_MARK}"), _MARK, -1)


def _blanked(text: Column, kind: str) -> Column:
    """The text with another character in the place of each of this kind's base spans."""
    covered = lambda p, i: F.when((i % 2 == 1) & _passes(kind)(p), F.repeat(F.lit(_OTHER), F.length(p))).otherwise(p)
    return F.when(_POSSIBLE[kind](text), F.array_join(F.transform(_cut(text, BASE[kind]), covered), "")).otherwise(text)


def find(text: Column, pattern: str) -> Column:
    """All matches in a text: an array of (start, end, what, before, after)."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)

    def located(pieces: Column, lengths: Column, starts: Column) -> Column:
        def one(i: Column) -> Column:
            g = F.floor(i / _GROUP).cast("int")
            at = F.get(starts, g) + total(F.slice(lengths, g * _GROUP + 1, F.pmod(i, F.lit(_GROUP))))
            return F.struct(
                at.alias("start"),
                (at + F.get(lengths, i)).alias("end"),
                F.get(pieces, i).alias("what"),
                F.right(F.get(pieces, i - 1), F.lit(24)).alias("before"),
                F.left(F.get(pieces, i + 1), F.lit(8)).alias("after"),
            )

        return F.transform(F.sequence(F.lit(1), F.size(pieces) - 2, F.lit(2)), one)

    def summed(pieces: Column, lengths: Column) -> Column:
        # running sums in two steps, over groups and then within one, so that many matches stay cheap
        groups = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _GROUP).cast("int")),
            lambda g: total(F.slice(lengths, g * _GROUP + 1, _GROUP)),
        )
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
        step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all"))
        return let(F.aggregate(groups, zero, step)["all"], lambda starts: located(pieces, lengths, starts))

    def pieces_of(pieces: Column) -> Column:
        some = let(F.transform(pieces, F.length), lambda lengths: summed(pieces, lengths))
        return F.when(F.size(pieces) > 2, some).otherwise(_nothing())

    return let(_cut(text, pattern), pieces_of)


def _digits(what: Column) -> Column:
    return F.regexp_replace(what, "[^0-9]", "")


def _passes(kind: str) -> Match:
    if kind == "ip":
        return lambda what: what.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return lambda what: let(
            _digits(what), lambda d: F.length(d).between(14, 19) & F.call_function("luhn_check", d)
        )
    if kind == "phone":
        return lambda what: F.length(_digits(what)).between(10, 15)
    return lambda what: F.lit(True)


#: Cheap tests that no text with a match fails.
_POSSIBLE = {
    "email": lambda t: F.contains(t, F.lit("@")) | t.rlike(r"[(\[{]\x20?at\x20?[)\]}]"),
    "ip": lambda t: t.rlike(r"[0-9]\x20?(?:\.|\[\.\])\x20?[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
    "number": lambda t: t.rlike(r"[0-9](?:[\x20()./-]{0,2}[0-9]){6}"),
}


def _passing(kind: str) -> Match:
    return lambda m: _passes(kind)(m["what"])


def _as_base(no: int) -> Match:
    return lambda m: F.struct(m["start"].alias("start"), F.lit(no).alias("no"), m["end"].alias("end"))


def _as_candidate(generator: str) -> Match:
    long = lambda m: F.when(F.length(_digits(m["what"])) >= 14, F.lit(KINDS.index("card"))).otherwise(F.lit(KINDS.index("phone")))
    no = (lambda m: F.lit(KINDS.index(generator))) if generator in KINDS else long
    return lambda m: F.struct(no(m).alias("no"), *[m[c].alias(c) for c in ("start", "end", "what", "before", "after")])


def _with_spans(df: DataFrame, text_col: str, beside: bool, keep: Sequence[str] | None = None) -> DataFrame:
    """(doc, base, loose): base spans per row as (start, no, end), and candidates; only those beside the base, or all."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kept_columns = df.columns if keep is None else keep
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in kept_columns]).alias("doc"), text.alias("t"))
    rest = F.col("t")
    for k in KINDS if beside else ():
        rows, rest = rows.withColumn("rest", _blanked(rest, k)), F.col("rest")
    t = F.col("t")
    matched = rows.select(
        "doc",
        *[
            F.when(_POSSIBLE[k](t), F.filter(find(t, BASE[k]), _passing(k))).otherwise(_nothing()).alias(f"b_{k}")
            for k in KINDS
        ],
        *[F.when(_POSSIBLE[k](rest), find(rest, LOOSE[k])).otherwise(_nothing()).alias(f"l_{k}") for k in LOOSE],
    )
    base = F.concat(*[F.transform(f"b_{k}", _as_base(no)) for no, k in enumerate(KINDS)])
    loose = F.concat(*[F.transform(f"l_{k}", _as_candidate(k)) for k in LOOSE])
    return matched.select("doc", F.array_sort(base).alias("base"), loose.alias("loose"))


def _featured(df: DataFrame) -> DataFrame:
    """Feature columns of a candidate in columns no, what, before, after."""
    count = lambda sign: F.length("what") - F.length(F.regexp_replace("what", sign, ""))
    groups = F.filter(F.split("what", "[^0-9A-Za-z]+"), lambda g: g != "")
    sizes = F.transform(groups, F.length)
    values = {
        **{f"is_{k}": F.col("no") == i for i, k in enumerate(KINDS)},
        "n": F.length("what"),
        "digits": count("[0-9]"),
        "letters": count("[A-Za-z]"),
        "blanks": count("\\x20"),
        "dashes": count("-"),
        "dots": count("\\."),
        "brackets": count("[()\\[\\]{}]"),
        "groups": F.size(groups),
        "longest": F.array_max(sizes),
        "first_group": F.get(sizes, F.lit(0)),
        "last_group": F.element_at(sizes, -1),
        "before_word": F.col("before").rlike("[A-Za-z]\\x20?$"),
        "after_word": F.col("after").rlike("^\\x20?[A-Za-z]"),
        "before_digit": F.col("before").rlike("[0-9][^A-Za-z]?$"),
        "after_digit": F.col("after").rlike("^[^A-Za-z]?[0-9]"),
        **{name: F.col("before").rlike(p) for name, p in _HINTS.items()},
    }
    typed = [F.coalesce(v.cast("double"), F.lit(0.0)).alias(f"f_{c}") for c, v in values.items()]
    return VectorAssembler(inputCols=[f"f_{c}" for c in FEATURES], outputCol="features").transform(df.select("*", *typed))


def _overlaps(a: Column, start: Column, end: Column) -> Column:
    return (a["start"] < end) & (start < a["end"])


class Judge:
    """Trees and the thresholds of the kinds; a threshold above 1 selects nothing."""

    def __init__(self, trees, thresholds: list[float]):
        self.trees, self.thresholds = trees, thresholds


def prior(n: int = 60, seed: int = 23) -> list[tuple[float, int, str, str, str]]:
    """Made-up candidates (label, kind number, what, before, after): per kind ``n`` of each label."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("an ber co del fa go hil ma no ra sen ti".split()) for _ in range(rng.randint(1, 4)))
    digits = lambda n: str(rng.randint(1, 9)) + "".join(str(rng.randint(0, 9)) for _ in range(n - 1))
    grouped = lambda sizes, sign: sign.join(digits(g) for g in sizes)
    at = lambda: rng.choice(["@", " @ ", " [at] ", "(at)", " (at) ", "{at}"])
    dot = lambda: rng.choice([".", ".", " [dot] ", "(dot)", " (dot) "])
    mid = lambda: rng.choice([".", " . ", "[.]", "[.]", " [.] "])
    sep = lambda: rng.choice(["-", " ", ".", ""])

    def made(label: int, no: int) -> str:
        if no == 0:
            return word() + at() + dot().join(word() for _ in range(rng.randint(2, 3))) if label else digits(rng.randint(1, 2)) + " @ " + grouped((rng.randint(1, 3), 2), ".")
        if no == 1:
            sign, most = mid(), 255 if label else 999
            parts = [rng.randint(0, most) for _ in range(4)]
            return sign.join(map(str, parts if label or max(parts) > 255 else [*parts[:3], 256 + parts[3]]))
        if no == 2:
            return grouped((4, 4, 4, 4), rng.choice(["-", " ", "", "."])) if label else digits(rng.choice([14, 17, 20, 22, 25]))
        if label:
            return rng.choice([f"({digits(3)}) {digits(3)}{sep()}{digits(4)}", grouped((3, 3, 4), sep()), grouped((2, 3, 3, 4), sep()), digits(11)])
        return rng.choice([digits(rng.randint(7, 9)), f"20{rng.randint(10, 29)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", grouped((4, 4), "-")])

    hints = ("write to ", "host ", "card ", "call ")
    out = []
    for no in range(len(KINDS)):
        for i in range(2 * n):
            before = rng.choice([hints[no], word() + " ", word() + ": ", word() + ", ", ""]) if i % 2 else rng.choice(["order ", "no. ", word() + " ", word() + ", "])
            out.append((float(i % 2), no, made(i % 2, no), before, rng.choice(["", " ", ".", ", ", " " + word()])))
    return out


def _sure_not(c: str) -> Column:
    """A candidate that is none of its kind in any writing."""
    what, digits = F.col(f"{c}.what"), _digits(F.col(f"{c}.what"))
    kind = lambda k: F.col(f"{c}.no") == KINDS.index(k)
    ip = kind("ip") & ~_passes("ip")(F.regexp_replace(what, r"[\x20\[\]]", ""))
    card = kind("card") & ~_passes("card")(what)
    date = what.rlike(r"^(?:19|20)[0-9]{2}[-/.](?:0?[1-9]|1[0-2])[-/.](?:[0-2]?[0-9]|3[01])(?![0-9])")
    return ip | card | (kind("phone") & ((F.length(digits) < 10) | date))


def _variants(no: Column, what: Column) -> Column:
    """Other writings of a base span as the loose generators would take them, and itself."""
    swap = lambda *pairs: [F.regexp_replace(F.regexp_replace(what, "\\x20?@\\x20?", a), "\\.", d) for a, d in pairs]
    dots = [F.regexp_replace(what, r"\.", d) for d in ("[.]", " . ", " [.] ")]
    bare = _digits(what)
    cards = [bare, *[F.rtrim(F.regexp_replace(bare, "(.{4})", f"$1{sign}"), F.lit(sign)) for sign in " -."]]
    plain = F.regexp_replace(what, r"^\+", "")
    phones = [plain, bare, *[F.regexp_replace(plain, r"[^0-9]+", sign) for sign in " -."]]
    of = {"email": swap((" [at] ", " [dot] "), (" (at) ", " (dot) "), ("(at)", "."), (" @ ", ".")), "ip": dots, "card": cards, "phone": phones}
    each = F.element_at(F.array(*[F.array(what, *of[k]) for k in KINDS]), no + 1)
    return F.array_distinct(each)


def fit(df: DataFrame, precision: float = 0.95, text_col: str = "text", seed: int = 17) -> Judge | None:
    texts = df.select(F.col(text_col).cast("string").alias("text"))
    spans = _with_spans(texts, "text", beside=False)
    met = F.filter("base", lambda b: _overlaps(b, F.col("c.start"), F.col("c.end")))
    own = F.exists("met", lambda b: b["no"] == F.col("c.no"))
    label = F.when(own, F.lit(1.0)).when((F.size("met") > 0) | _sure_not("c"), F.lit(0.0))
    found = spans.select("base", F.explode("loose").alias("c"), F.xxhash64("doc").alias("from")).withColumn("met", met)
    writings = F.when(F.col("label") == 1, _variants(F.col("c.no"), F.col("c.what"))).otherwise(F.array("c.what"))
    fields = ["label", "no", "what", "before", "after", "held"]
    labelled = found.withColumn("label", label).select(
        "label", "c.no", F.explode(writings).alias("what"), "c.before", "c.after", (F.pmod("from", F.lit(2)) == 1).alias("held")
    )
    labelled = kept(labelled)  # every row's candidates, searched for once
    if labelled.limit(1).count() == 0:
        return None
    made = [
        F.struct(*[F.lit(v).alias(c) for c, v in zip(fields, (*e, i // 2 % 2 == 1))]) for i, e in enumerate(prior())
    ]
    together = labelled.where("label IS NOT NULL").unionByName(df.sparkSession.range(1).select(F.inline(F.array(*made))))
    examples = kept(_featured(together).select("label", "features", "no", "held"))
    trees = GBTClassifier(maxIter=12, maxDepth=3, stepSize=0.2, seed=seed).fit(examples.where("NOT held"))
    scored = trees.transform(examples.where("held")).select(
        "no", "label", F.floor(vector_to_array("probability")[1] * 200).alias("step")
    )
    found = scored.groupBy("no", "step").agg(F.count("*").alias("n"), F.sum("label").alias("right")).collect()
    thresholds = []
    for no in range(len(KINDS)):
        steps = sorted(((r["step"], r["n"], r["right"]) for r in found if r["no"] == no), reverse=True)
        best, right, seen = 2.0, 0.0, 0
        for step, n_step, r_step in steps:
            right, seen = right + r_step, seen + n_step
            if right >= precision * seen and seen >= 10:
                best = step / 200
        thresholds.append(best if sum(n for _, n, _ in steps) >= 20 else 2.0)
    return Judge(trees, thresholds)


def scan(df: DataFrame, judge: Judge | None, text_col: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """(doc, base, added): arrays of (start, no, end), ``no`` counting in KINDS, each ordered by start, then kind.

    ``keep`` names the columns of ``doc``, all by default; what it leaves out, the text above all, is not shuffled.
    """
    spans = _with_spans(df, text_col, beside=True, keep=keep)
    none = F.array().cast("array<struct<start: int, no: int, end: int>>")
    if judge is None:
        return spans.select("doc", "base", none.alias("added"))
    free = F.filter("loose", lambda m: ~F.exists("base", lambda b: _overlaps(b, m["start"], m["end"])))
    rows = spans.select(F.monotonically_increasing_id().alias("row"), "doc", "base", free.alias("free"))
    each = rows.select("row", "doc", "base", F.explode_outer("free").alias("c")).select("row", "doc", "base", "c.*")
    scored = judge.trees.transform(_featured(each)).withColumn("p", vector_to_array("probability")[1])
    limit = F.element_at(F.array(*[F.lit(x) for x in judge.thresholds]), F.col("no") + 1)
    good = F.when(
        F.col("no").isNotNull() & (F.col("p") >= limit),
        F.struct((-F.col("p")).alias("p"), F.col("start"), F.col("no"), F.col("end")),
    )
    return (
        scored.groupBy("row")
        .agg(F.first("doc").alias("doc"), F.first("base").alias("base"), F.array_sort(F.collect_list(good)).alias("good"))
        .select("doc", "base", _best_apart(F.col("good")).alias("added"))
    )


def _best_apart(good: Column) -> Column:
    """Of spans ordered by preference, those that overlap none taken before, ordered by start, then kind."""
    empty = F.array().cast("array<struct<start: int, no: int, end: int>>")
    bare = lambda g: F.struct(g["start"].alias("start"), g["no"].alias("no"), g["end"].alias("end"))
    step = lambda acc, g: F.when(
        F.exists(acc, lambda a: _overlaps(a, g["start"], g["end"])), acc
    ).otherwise(F.concat(acc, F.array(bare(g))))
    return F.array_sort(F.aggregate(good, empty, step))
