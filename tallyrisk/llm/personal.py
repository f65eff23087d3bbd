"""Personal data by weak supervision, in DataFrame expressions only.

Patterns propose candidate spans. Five labelers vote on each (for, against or not at all): its format or checksum, a gazetteer, cue
words before it, its neighbours and the variety of its digits. Candidates collapse to their votes and two facts of shape, at most
MOST_CODES different codes however large the corpus. Expectation-maximisation over the counted codes estimates how reliable each
labeler is and how often a candidate of each kind is personal; its probabilities train a logistic classifier of spans. Both
fits are folds over one array of codes and counts in one row. The base kinds' valid matches always stay, candidates of the other
kinds are spans where the classifier says so.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrisk.landing import land
from tallyrisk.llm.common import free_name, query, quoted, table

LABELERS = ("format", "gazetteer", "context", "bounds", "variety")
AGAINST, ABSTAINS, FOR = 0, 1, 2
# Characters before a span in which cue words count; presumed vote shares of a labeler on personal and other candidates, which
# weigh PRESUMED of all candidates; rounds of both fits; the classifier's step and penalty; the least probability of a span.
CONTEXT, PRESUMED, EM_ROUNDS = 48, 0.2, 30
SHARES = ((0.5, 0.3, 0.2), (0.1, 0.4, 0.5))
STEPS, STEP, RIDGE, LEAST = 200, 0.4, 1e-3, 0.5


@dataclass(frozen=True)
class Kind:
    """`pattern` lists the candidates (without backtracking into what repeats), every match holds `hint`; cues count in either case."""

    name: str
    pattern: str
    hint: str
    cues: str


# The contract's four kinds, then those of the method, as they are listed.
_LOCAL = "A-Za-z0-9._%+-"
_AT, _DOT = r"\x20?[\[({]\x20?(?:at|AT)\x20?[\])}]\x20?", r"\x20?[\[({]\x20?(?:dot|DOT)\x20?[\])}]\x20?"
TITLES = "Mr Mrs Ms Dr Prof Herr Frau Madame Monsieur Señor Señora".split()
GIVEN_NAMES = ("Alice Andrew Anna Antonio Barbara Carlos Charles Christine Claire Daniel David Elizabeth Emily Emma Frank François George Hans "
               "Heinrich Henry Isabel James Javier Jean Jennifer Johann John José Juan Julia Karl Katharina Laura Linda Louis Lucía Manuel "
               "Margaret María Marie Mary Michael Miguel Nicolas Patricia Paul Peter Philippe Pierre Robert Sarah Sofía Sophie Stefan Susan "
               "Thomas Ursula William Wolfgang").split()
KINDS = (
    Kind("email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", "mail|contact|write|reach|courriel|correo|kontakt"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "ip|address|host|login|client|adresse|dirección"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){11}", "card|visa|master|credit|debit|paid|karte|carte|tarjeta"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", "phone|tel|call|fax|mobile|telefon|teléfono|téléphone|anruf"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]-[0-9]{2}-[0-9]", "ssn|social security|security number|taxpayer"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}", "iban|account|konto|compte|cuenta|transfer"),
    Kind("local_phone", r"(?<![0-9A-Za-z+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])", r"[0-9][\x20.-][0-9]{4}", "phone|tel|call|fax|mobile|telefon|teléfono|téléphone|anruf"),
    Kind("at_mail", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++", _AT, "mail|contact|write|reach|courriel|correo|kontakt"),
    Kind("person", rf"(?<!\p{{L}})(?:(?:{'|'.join(TITLES)})\.?(?:\x20\p{{Lu}}\p{{Ll}}++){{1,2}}+|(?:{'|'.join(GIVEN_NAMES)})\x20\p{{Lu}}\p{{Ll}}++)",
         rf"(?:{'|'.join(TITLES)}|{'|'.join(GIVEN_NAMES)})\.?\x20\p{{Lu}}", "name|signed|by|sincerely|dear|regards|von|señor|monsieur|author"),
    Kind("birth", r"(?<![0-9./-])(?:[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})(?![0-9./-])",
         "(?:19|20)[0-9]{2}", "born|birth|dob|geboren|née?|nacid[oa]"),
)
BASE_KINDS = 4
COUNTER_CUES = "version|release|build|isbn|issn|order|invoice|item|page|chapter|section|figure|table|commit|serial|model|ratio"
DOMAIN_ENDS = "com org net edu gov io info biz eu de fr es uk us ca au ch at it nl be se no dk pl pt br mx jp cn in ru".split()
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 358 420 421 971 972".split()
IBAN_COUNTRIES = "AD AE AL AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM TR".split()
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[05-8]|34|60|62|64|65)"
_PART = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})?"
IP = rf"^{_PART}(?:\.{_PART}){{3}}$"
_SHAPES = 4
MOST_CODES = len(KINDS) * 3 ** len(LABELERS) * _SHAPES


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _total(numbers: Column, of: str = "int") -> Column:
    return F.aggregate(numbers, F.lit(0).cast(of), lambda a, b: a + b)


def luhn(digits: Column) -> Column:
    """True where the digits pass the Luhn check."""
    each = F.split(F.reverse(digits), "").cast("array<int>")
    return _total(F.transform(each, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))) % 10 == 0


def _remainder_97(iban: Column) -> Column:
    clean = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.split(F.concat(clean.substr(F.lit(5), F.length(clean)), F.left(clean, F.lit(4))), "")
    return F.aggregate(turned, F.lit(0), lambda a, c: F.when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def valid(kind: str, whole: Column) -> Column | None:
    """The strict check of a kind's format or checksum; None where its pattern is all there is."""
    n = F.length(_digits(whole))
    if kind == "email":
        return whole.rlike(r"[A-Za-z]$")
    if kind == "ip":
        return whole.rlike(IP)
    if kind == "card":
        return F.when(n.between(12, 19), luhn(_digits(whole))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    if kind == "ssn":
        return ~whole.rlike("^(?:000|666|9)|-00-|-0000$")
    if kind == "iban":
        return _remainder_97(whole) == 1
    if kind == "local_phone":
        return whole.rlike(r"^\(?[2-9][0-9]{2}\)?[\x20.-]?[2-9]")
    if kind == "birth":
        return ~whole.rlike(r"^0?0[./-]|[./-]0?0[./-]|^[4-9][0-9][./-]|^3[2-9][./-]|-(?:1[3-9]|[2-9][0-9])-[0-9]{2}$")
    return None


def is_base(order: int, whole: Column) -> Column:
    """Matches that the contract keeps: every email, and those of the other base kinds that pass."""
    if order >= BASE_KINDS:
        return F.lit(False)
    return F.lit(True) if KINDS[order].name == "email" else valid(KINDS[order].name, whole)


def _vote(good: Column | None, bad: Column | None) -> Column:
    out = F.lit(ABSTAINS)
    if bad is not None:
        out = F.when(bad, AGAINST).otherwise(out)
    return out if good is None else F.when(good, FOR).otherwise(out)


def _gazetteer(kind: str, whole: Column) -> Column:
    if kind in ("email", "at_mail"):
        return _vote(F.lower(F.regexp_extract(whole, "(?<![A-Za-z0-9-])[A-Za-z0-9-]++$", 0)).isin(DOMAIN_ENDS), F.lower(whole).rlike("^(?:noreply|no-reply|info|support|admin|webmaster)[^a-z]"))
    if kind == "ip":
        return _vote(None, whole.rlike(r"^(?:0|10|127|255|192\.168|169\.254)\."))
    if kind == "card":
        good = whole.rlike(ISSUERS)
    elif kind == "phone":
        good = F.exists(F.array(*[F.left(_digits(whole), F.lit(i)) for i in (1, 2, 3)]), lambda c: c.isin(CALLING_CODES))
    elif kind == "iban":
        good = F.left(whole, F.lit(2)).isin(IBAN_COUNTRIES)
    elif kind == "person":
        return _vote(whole.rlike(rf"(?:^|\x20)(?:{'|'.join(GIVEN_NAMES)})\x20"), None)
    else:
        return F.lit(ABSTAINS)
    return _vote(good, ~good)


def votes(order: int, whole: Column, before: Column, after: Column) -> list[Column]:
    """The labelers' votes on a candidate, given the characters before it and the one behind it."""
    kind = KINDS[order]
    passes = valid(kind.name, whole)
    cue, counter = (before.rlike(rf"(?i)(?<!\p{{L}})(?:{c})") for c in (kind.cues, COUNTER_CUES))
    # A date is nobody's without a cue.
    context = _vote(cue, ~cue if kind.name == "birth" else counter)
    embedded = before.rlike(r"[\p{L}\p{N}_=/#&-]$") | after.rlike(r"^[\p{L}\p{N}_=/#&]")
    few = F.when(F.length(_digits(whole)) >= 9, F.size(F.array_distinct(F.split(_digits(whole), ""))) < 3).otherwise(False)
    return [F.lit(ABSTAINS) if passes is None else _vote(passes, ~passes), _gazetteer(kind.name, whole), context, _vote(~embedded, embedded), _vote(None, few)]


def _code(order: int, cast: list[Column], whole: Column) -> Column:
    """Kind, votes and shape as one number under MOST_CODES."""
    code = F.lit(order)
    for v in cast:
        code = code * 3 + v
    return (code * _SHAPES + F.when(F.length(whole) >= 14, 2).otherwise(0) + F.when(F.contains(whole, F.lit(" ")), 1).otherwise(0)).cast("int")


_SPANS = "array<struct<start:int,kind:int,end:int,base:boolean,code:int>>"


def _candidates(text: Column, order: int) -> Column:
    """The candidates of one kind: leftmost matches that do not overlap, in code points."""
    kind, none = KINDS[order], F.array().cast(_SPANS)
    cut = F.struct(F.split(text, kind.pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("wholes"))

    def placed(both: Column) -> Column:
        def step(state: Column, one: Column) -> Column:
            start = state["at"] + F.length(both["gaps"][one["i"]])
            end = start + F.length(one["whole"])
            before = F.right(both["gaps"][one["i"]], F.lit(CONTEXT))
            cast = votes(order, one["whole"], before, F.left(both["gaps"][one["i"] + 1], F.lit(1)))
            span = F.struct(start.alias("start"), F.lit(order).alias("kind"), end.alias("end"), is_base(order, one["whole"]).alias("base"),
                            _code(order, cast, one["whole"]).alias("code"))
            # Shorter numbers are no cards at all.
            wanted = F.length(_digits(one["whole"])).between(12, 19) if kind.name == "card" else F.lit(True)
            return F.struct(end.alias("at"), F.when(wanted, F.concat(state["spans"], F.array(span).cast(_SPANS))).otherwise(state["spans"]).alias("spans"))

        wholes = F.transform(both["wholes"], lambda w, i: F.struct(w.alias("whole"), i.alias("i")))
        return F.aggregate(wholes, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda s: s["spans"])

    return F.when(text.rlike(kind.hint), bound(cut, placed)).otherwise(none)


def candidates(text: Column) -> Column:
    """Every candidate span of a text with its code, by start and kind; a NULL text has none."""
    whole = F.coalesce(text, F.lit(""))
    return F.array_sort(F.concat(*[_candidates(whole, order) for order in range(len(KINDS))]))


# -- the two fits, as folds over the counted codes

def decoded(code: Column) -> tuple[Column, Column, Column]:
    """(kind, votes, shape) of a code."""
    cast = F.floor(code / _SHAPES)
    marks = F.array(*[F.pmod(F.floor(cast / 3 ** (len(LABELERS) - 1 - i)), F.lit(3)).cast("int") for i in range(len(LABELERS))])
    return F.floor(cast / 3 ** len(LABELERS)).cast("int"), marks, F.pmod(code, F.lit(_SHAPES))


def features(code: Column) -> Column:
    """What the classifier sees of a candidate: its kind, votes for and against, and shape."""
    kind, marks, shape = decoded(code)
    flags = [kind == k for k in range(len(KINDS))] + [marks[i] == v for i in range(len(LABELERS)) for v in (AGAINST, FOR)] + [shape >= 2, shape % 2 == 1]
    return F.array(*[f.cast("double") for f in flags])


N_FEATURES = len(KINDS) + 2 * len(LABELERS) + 2


def _doubles(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _posterior(one: Column, model: Column) -> Column:
    """Probability that a candidate with these votes is personal."""
    odds = F.log(model["prior"][one["kind"]] / (1 - model["prior"][one["kind"]]))
    for i in range(len(LABELERS)):
        odds = odds + F.log(F.element_at(model["rates"], one["votes"][i] + (6 * i + 4)) / F.element_at(model["rates"], one["votes"][i] + (6 * i + 1)))
    return 1 / (1 + F.exp(-odds))


def _reestimated(model: Column, seen: Column) -> Column:
    """One round: probabilities of all candidates, then the labelers' rates on both classes and each kind's share."""
    weighed = F.transform(seen, lambda s: F.struct(s["kind"].alias("kind"), s["votes"].alias("votes"), s["n"].alias("n"),
                                                   (s["n"] * _posterior(s, model)).alias("yes")))

    def fitted(w: Column) -> Column:
        total = _total(F.transform(w, lambda s: s["n"]), "double")
        base = PRESUMED * total + 1

        def rate(j: Column) -> Column:
            labeler, personal, vote = F.floor(j / 6).cast("int"), F.floor(j / 3) % 2 == 1, (j % 3).cast("int")
            mass = F.transform(w, lambda s: F.struct(F.when(personal, s["yes"]).otherwise(s["n"] - s["yes"]).alias("m"), (s["votes"][labeler] == vote).alias("hit")))
            hits = _total(F.transform(mass, lambda m: F.when(m["hit"], m["m"]).otherwise(F.lit(0.0))), "double")
            share = F.element_at(_doubles([*SHARES[0], *SHARES[1]]), (j % 6 + 1).cast("int"))
            return (hits + base * share) / (_total(F.transform(mass, lambda m: m["m"]), "double") + base)

        def prior(k: Column) -> Column:
            mine = F.filter(w, lambda s: s["kind"] == k)
            return (_total(F.transform(mine, lambda s: s["yes"]), "double") + 2) / (_total(F.transform(mine, lambda s: s["n"]), "double") + 4)

        return F.struct(F.transform(F.sequence(F.lit(0), F.lit(len(KINDS) - 1)), prior).alias("prior"),
                        F.transform(F.sequence(F.lit(0), F.lit(6 * len(LABELERS) - 1)), rate).alias("rates"))

    return bound(weighed, fitted)


def _descended(weights: Column, rows: Column, total: Column) -> Column:
    """One step of gradient descent of the ridge logistic loss against the estimated probabilities."""
    residuals = F.transform(rows, lambda r: F.struct(r["x"].alias("x"), (r["n"] * (r["soft"] - probability(weights, r["x"]))).alias("r")))
    none = _doubles([0.0] * N_FEATURES)
    slope = F.aggregate(residuals, none, lambda a, r: F.zip_with(a, r["x"], lambda g, x: g + r["r"] * x))
    return F.zip_with(weights, slope, lambda w, g: w + STEP * (g / total - RIDGE * w))


def probability(weights: Column, x: Column) -> Column:
    return 1 / (1 + F.exp(-_total(F.zip_with(weights, x, lambda w, v: w * v), "double")))


def fit(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One written row: `prior` of each kind, `rates` (labeler, class, vote) of the labelers, and the classifier's `weights`.

    Fitted to all candidates of all rows; without any, the presumed rates and weights of zero.
    """
    seen = docs.select(F.explode(candidates(F.col(quoted(text_col)))).alias("c")).groupBy("c.code").agg(F.count(F.lit(1)).cast("double").alias("n"))
    one = seen.agg(F.array_sort(F.collect_list(F.struct("code", "n"))).alias("codes"))  # at most MOST_CODES

    def told(c: Column) -> Column:
        kind, marks, _ = decoded(c["code"])
        return F.struct(kind.alias("kind"), marks.alias("votes"), c["n"].alias("n"), features(c["code"]).alias("x"))

    one = one.select(F.transform("codes", told).alias("seen"))
    start = F.struct(_doubles([0.5] * len(KINDS)).alias("prior"), _doubles([*SHARES[0], *SHARES[1]] * len(LABELERS)).alias("rates"))
    rounds = F.sequence(F.lit(1), F.lit(EM_ROUNDS))
    one = one.select("seen", F.aggregate(rounds, start, lambda model, _: _reestimated(model, F.col("seen"))).alias("model"))
    one = land(one.select("model", F.transform("seen", lambda s: F.struct(s["x"].alias("x"), s["n"].alias("n"), _posterior(s, F.col("model")).alias("soft"))).alias("rows")),
               "personal-labels")
    total = F.greatest(_total(F.transform("rows", lambda r: r["n"]), "double"), F.lit(1.0))
    weights = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), _doubles([0.0] * N_FEATURES), lambda w, _: _descended(w, F.col("rows"), total))
    return land(one.select("model.prior", "model.rates", weights.alias("weights")), "personal-model")


def personal_spans(docs: DataFrame, text_col: str = "text", model: DataFrame | None = None) -> DataFrame:
    """The rows of `docs` with a column `personal_spans` added: (start, kind, end) of every span, kind being the place in KINDS.

    The valid matches of the base kinds, and the candidates of other kinds that the classifier takes and that overlap none of them.
    NULL and empty texts have no spans, repeated rows are judged as they come, an empty table gives an empty one. Where `docs` has
    a column of that name, the new one gets underscores behind its name.
    """
    learnt = (fit(docs, text_col) if model is None else model).select("weights").scalar()
    name, held, weights = (free_name(docs.columns, n) for n in ("personal_spans", "personal_candidates", "personal_weights"))

    def chosen(both: Column) -> Column:
        base = F.filter(both["all"], lambda c: c["base"])
        added = F.filter(both["all"], lambda c: (c["kind"] >= BASE_KINDS) & (probability(both["weights"], features(c["code"])) > LEAST))
        return bound(F.struct(base.alias("base"), added.alias("added")), lambda b: F.array_sort(F.concat(
            b["base"], F.filter(b["added"], lambda c: ~F.exists(b["base"], lambda x: (x["start"] < c["end"]) & (c["start"] < x["end"]))))))

    spans = bound(F.struct(F.col(held).alias("all"), F.col(weights).alias("weights")), chosen)
    slim = F.transform(spans, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    found = docs.withColumns({held: candidates(F.col(quoted(text_col))), weights: learnt})
    return found.withColumn(name, F.when(F.size(held) > 0, slim).otherwise(none)).drop(held, weights)


def masked(docs: DataFrame, text_col: str = "text", mark: str = "[personal]", model: DataFrame | None = None) -> DataFrame:
    """The rows of `docs` with every span replaced by `mark`, overlapping ones as one; a NULL text stays NULL."""
    name = free_name(docs.columns, "personal_spans")
    found, text = personal_spans(docs, text_col, model), F.col(quoted(text_col))

    def step(state: Column, span: Column) -> Column:
        gap = F.when(span["start"] >= state["at"], F.concat(text.substr(state["at"] + 1, span["start"] - state["at"]), F.lit(mark))).otherwise("")
        return F.struct(F.greatest(span["end"], state["at"]).alias("at"), F.concat(state["out"], gap).alias("out"))

    cut = F.aggregate(name, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda s: F.concat(s["out"], text.substr(s["at"] + 1, F.length(text))))
    return found.withColumn(text_col, F.when(F.size(name) > 0, cut).otherwise(text)).drop(name)


def _told(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k.name) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op11_weak_labels")
def op11(spark, sf_dir):
    """doc_id, counts of the base kinds, digest of the base spans and all spans of every document."""
    found = personal_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("personal_spans")

    def of(kind: int) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind].name}")

    base = F.filter(spans, lambda s: s["kind"] < BASE_KINDS)
    return found.select("doc_id", *map(of, range(BASE_KINDS)), F.sha2(_told(base).cast("binary"), 256).alias("base_sha256"), _told(spans).alias("spans"))
