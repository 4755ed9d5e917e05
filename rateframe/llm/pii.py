"""Personal data by weak supervision, in DataFrame functions only.

Exact patterns give base spans, which always stay. Looser patterns give further candidates. Labelers vote
on every candidate (1 yes, -1 no, 0 no opinion): the exact pattern with its checks, gazetteers (mail
domains, reserved networks, card issuers, calling codes), words before it for and against, and its edges.
Votes are counted by pattern over the whole table. Expectation-maximisation on these counts estimates how
reliable each labeler is and how likely each pattern is right; a logistic classifier is then trained on the
expected labels and decides on the candidates that are no base spans.

A text is handled in pieces that end where no span can go on, so the work grows with its length, not with
its square; only a run without such a place (digits and spaces, say) stays one piece however long.

Text positions are code points. Repeated groups would recurse in the regex engine on long texts. So the dots of
domains and the separators inside digit runs are first replaced by one mark, which keeps all positions,
and the patterns are runs of single characters.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rateframe.llm.textops import collect_bounded, own_names, unpacked

KINDS = ("email", "ip", "card", "phone")
MARK = "\ue000"  # private use; where a text has it, another private character stands in
CONTEXT = 32
PIECE = 4000
# A character of no pattern, or a space that no pattern goes across.
_CUT = "(?:[^A-Za-z0-9\\u00C0-\\u024F._%+@ ()\\[\\]-]|[A-Za-z] (?=[A-Za-z0-9+])|[0-9] (?=[A-Za-z+]))"
EM_ROUNDS = 100
START_SHARE = 0.4
_NEAR_LETTER = "[A-Za-z0-9_\\u00C0-\\u024F]"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"

# Words that speak for or against each kind when they stand shortly before it.
FOR = {
    "email": "e-?mail|mail|contact|write to|reach|courriel|correo|kontakt",
    "ip": "ip|address|host|server|login from|adresse|servidor",
    "card": "card|credit|visa|mastercard|amex|payment|carte|tarjeta|kreditkarte",
    "phone": "phone|tel|call|mobile|cell|fax|whatsapp|appel|llame|telefon",
}
AGAINST = "version|release|section|chapter|isbn|issn|order|invoice|serial|figure|table|page|build|rfc"
# Endings of mail domains.
ENDINGS = "com|org|net|edu|gov|mil|int|info|biz|io|co|de|fr|es|it|uk|us|ca|eu|ch|at|be|nl|pt|pl|se|no|dk|fi|ru|cn|jp|in|br|mx|au"

LABELERS = ("exact", "gazetteer", "words_for", "words_against", "edges")


# --- spans ----------------------------------------------------------------------

def _empty() -> Column:
    return F.expr("CAST(array() AS array<struct<start: int, stop: int, found: string>>)")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _pieces(text: Column) -> Column:
    """The text in pieces of at least PIECE code points (the last one of any length), each with its place and
    the characters before it. They end where every pattern of this module has to stop."""
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{{PIECE}}}.*?{_CUT}|.+"), F.lit(0))

    def placed(own: Column) -> Column:
        sums = F.aggregate(
            own, F.array(F.lit(0)), lambda done, piece: F.concat(done, F.array(F.element_at(done, -1) + F.length(piece)))
        )
        before = lambda i: F.coalesce(F.right(F.get(own, i - 1), F.lit(CONTEXT)), F.lit(""))
        return _once(
            sums, lambda at: F.transform(own, lambda p, i: F.struct(F.get(at, i).alias("at"), before(i).alias("before"), p.alias("own")))
        )

    whole = F.array(F.struct(F.lit(0).alias("at"), F.lit("").alias("before"), text.alias("own")))
    return F.when(F.length(text) <= PIECE, whole).otherwise(_once(cut, placed))


def _located(text: Column, pattern: str) -> Column:
    """All matches with begin and end, by adding up the text between them."""
    return _once(text, lambda t: _once(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda found: _summed(t, pattern, found)))


def _summed(text: Column, pattern: str, found: Column) -> Column:
    pieces = F.zip_with(found, F.split(text, pattern), lambda m, piece: F.struct(m.alias("m"), piece.alias("piece")))
    start = F.struct(F.lit(0).alias("at"), _empty().alias("spans"))

    def add(state: Column, entry: Column) -> Column:
        first = state["at"] + F.length(entry["piece"])
        last = first + F.length(entry["m"])
        span = F.struct(first.alias("start"), last.alias("stop"), entry["m"].alias("found"))
        return F.struct(last.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    matched = F.filter(pieces, lambda e: e["m"].isNotNull())
    return F.when(F.size(found) > 0, F.aggregate(matched, start, add, lambda s: s["spans"])).otherwise(_empty())


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check sum."""
    backwards = F.split(F.reverse(digits), "")

    def term(digit: Column, place: Column) -> Column:
        doubled = digit.cast("int") * 2
        return F.when(place % 2 == 0, digit.cast("int")).otherwise(F.when(doubled > 9, doubled - 9).otherwise(doubled))

    real = F.filter(backwards, lambda d: d != "")
    return F.aggregate(F.transform(real, term), F.lit(0), lambda a, b: a + b) % 10 == 0


def _card_text(text: Column) -> Column:
    return F.regexp_replace(text, "(?<=[0-9])[ -](?=[0-9])", MARK)


def _mail_text(text: Column) -> Column:
    return F.regexp_replace(text, "(?<=[A-Za-z0-9-])\\.(?=[A-Za-z0-9-])", MARK)


def _if(condition: Column, spans: Column) -> Column:
    return F.when(condition, spans).otherwise(_empty())


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of each kind by its exact pattern and checks. ``text`` holds no mark."""
    local = f"[A-Za-z0-9._%+{MARK}-]"
    email = f"(?:\\G|(?<!{local})){local}++@[A-Za-z0-9-]++{MARK}[A-Za-z0-9{MARK}-]++"
    ip = "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++"
    card = f"[0-9][0-9{MARK}]+"
    phone = "\\+[0-9][ ().0-9-]+[0-9]"
    n_digits = lambda s: F.length(_digits(s["found"]))
    return {
        "email": _if(F.contains(text, F.lit("@")), _located(_mail_text(text), email)),
        "ip": _if(
            text.rlike("[0-9]\\.[0-9]"),
            F.filter(_located(text, ip), lambda s: s["found"].rlike(f"^{_PART}(?:\\.{_PART}){{3}}$")),
        ),
        "card": _if(
            text.rlike("(?:[0-9][ -]?){12}"),
            F.filter(
                _located(_card_text(text), card),
                lambda s: F.when(n_digits(s).between(12, 19), luhn(_digits(s["found"]))).otherwise(False),
            ),
        ),
        "phone": _if(
            F.contains(text, F.lit("+")), F.filter(_located(text, phone), lambda s: n_digits(s).between(9, 15))
        ),
    }


def loose_spans(text: Column) -> dict[str, Column]:
    """Further candidates: written-out mail addresses, and telephone numbers without a plus. Addresses and
    card numbers that fail the checks of their exact patterns are none."""
    spelled = "(?i)(?<![A-Za-z0-9])[a-z0-9._%+-]{1,64} ?[\\[(]at[\\])] ?[a-z0-9-]{1,63} ?[\\[(]dot[\\])] ?[a-z]{2,24}(?![A-Za-z])"
    phone = "(?<![0-9+.-])(?:\\([0-9]{3}\\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])"
    return {
        "email": _if(text.rlike("(?i)[\\[(]at[\\])]"), _located(text, spelled)),
        "ip": _empty(),
        "card": _empty(),
        "phone": _if(text.rlike("[0-9]{3}[.-][0-9]{4}"), _located(text, phone)),
    }


# --- votes ----------------------------------------------------------------------

def _gazetteer(kind: str, found: Column) -> Column:
    plain = F.lower(F.translate(found, MARK, "."))
    if kind == "email":
        yes, no = plain.rlike(f"[.\\])] ?(?:{ENDINGS})$"), F.lit(False)
    elif kind == "ip":
        yes, no = F.lit(False), plain.rlike("^(?:0|127|255)\\.|[0-9]{4}|[3-9][0-9]{2}|2[6-9][0-9]|25[6-9]")
    elif kind == "card":
        yes, no = F.regexp_replace(plain, "[^0-9]", "").rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)"), plain.rlike("^0")
    else:
        yes, no = F.regexp_replace(plain, "[^0-9+]", "").rlike("^\\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"), plain.rlike("^.?0?000")
    return F.when(no, -1).when(yes, 1).otherwise(0)


def _candidate(kind: str, order: int, wide: Column, lead: Column, exact: Column, span: Column) -> Column:
    """The span with its votes. ``wide`` is its piece with the ``lead`` characters before it."""
    begin = span["start"] + lead
    first = F.greatest(begin - CONTEXT, F.lit(0))
    before = F.lower(F.substring(wide, first + 1, begin - first))
    after = F.substring(wide, span["stop"] + lead + 1, F.lit(1))
    glued = before.rlike(f"{_NEAR_LETTER}$") | after.rlike(f"^{_NEAR_LETTER}")
    return F.struct(
        span["start"].alias("start"),
        F.lit(order).alias("order"),
        span["stop"].alias("stop"),
        F.lit(kind).alias("kind"),
        exact.alias("base"),
        F.when(exact, 1).otherwise(0).alias("exact"),  # no opinion on other forms
        _gazetteer(kind, span["found"]).alias("gazetteer"),
        F.when(before.rlike(f"\\b(?:{FOR[kind]})\\b"), 1).otherwise(0).alias("words_for"),
        F.when(before.rlike(f"\\b(?:{AGAINST})\\b"), -1).otherwise(0).alias("words_against"),
        F.when(glued, -1).otherwise(0).alias("edges"),
    )


def _with_votes(text: Column, wide: Column, lead: Column) -> Column:
    """Base spans of one piece, and the looser ones that overlap none of them, in order."""

    def voted(base: Column, loose: Column) -> Column:
        every = []
        for order, kind in enumerate(KINDS):
            vote = partial(_candidate, kind, order, wide, lead)
            every.append(F.transform(base[kind], partial(vote, F.lit(True))))
            apart = F.filter(
                loose[kind],
                lambda s: ~F.exists(F.concat(*[base[k] for k in KINDS]), lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])),
            )
            every.append(F.transform(apart, partial(vote, F.lit(False))))
        return F.array_sort(F.concat(*every))

    def kinds(spans: dict[str, Column]) -> Column:
        return F.struct(*[spans[k].alias(k) for k in KINDS])

    return _once(kinds(base_spans(text)), lambda base: _once(kinds(loose_spans(text)), lambda loose: voted(base, loose)))


def pieces_with_candidates(text: Column) -> Column:
    """The pieces of a text (null: none), each with ``at``, its ``own`` text and ``candidates`` placed within it."""

    def filled(piece: Column) -> Column:
        wide = F.translate(F.concat(piece["before"], piece["own"]), MARK, "\ue001")
        own = F.translate(piece["own"], MARK, "\ue001")
        found = _once(own, lambda t: _once(wide, lambda w: _with_votes(t, w, F.length(piece["before"]))))
        return F.struct(piece["at"].alias("at"), piece["own"].alias("own"), found.alias("candidates"))

    return F.transform(_pieces(F.coalesce(text, F.lit(""))), filled)


# --- aggregation and classifier ---------------------------------------------------

@dataclass
class SpanModel:
    accuracy: np.ndarray
    weights: np.ndarray

    def probability(self, candidate: Column) -> Column:
        score = F.lit(float(self.weights[-1]))
        for name, w in zip(LABELERS, self.weights):
            score = score + candidate[name] * F.lit(float(w))
        for kind, w in zip(KINDS, self.weights[len(LABELERS) :]):
            score = score + F.when(candidate["kind"] == kind, F.lit(float(w))).otherwise(F.lit(0.0))
        score = score + F.when(candidate["base"], F.lit(float(self.weights[-2]))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-score))


def expected_labels(
    votes: np.ndarray, group: np.ndarray, counts: np.ndarray, rounds: int = EM_ROUNDS
) -> tuple[np.ndarray, np.ndarray]:
    """Probability that each vote pattern is right, and the accuracy of each labeler where it votes.

    Labelers are taken as independent given the truth and better than chance; each group of patterns has
    its own share of right ones. A few imagined votes keep what hardly any vote tells near its start.
    """
    accuracy = np.full(votes.shape[1], 0.75)
    share = np.full(group.max() + 1, START_SHARE)
    sizes = np.bincount(group, counts)
    for _ in range(rounds):
        odds = np.log(share / (1 - share))[group] + votes @ np.log(accuracy / (1 - accuracy))
        right = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        agree = ((votes > 0) * right[:, None] + (votes < 0) * (1 - right[:, None])) * counts[:, None]
        voted = (votes != 0) * counts[:, None]
        accuracy = np.clip((agree.sum(axis=0) + 7.5) / (voted.sum(axis=0) + 10), 0.55, 0.99)
        voting = np.bincount(group, counts * right) + 10 * START_SHARE
        share = np.clip(voting / (sizes + 10), 0.02, 0.98)
    return right, accuracy


def fit_logistic(x: np.ndarray, label: np.ndarray, counts: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (counts * (label - p)) - ridge * w
        curve = (x * (counts * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, text: str = "text") -> SpanModel:
    """Labeler accuracies and the span classifier, from the candidates of all rows. Only the number of
    candidates of each kind and vote pattern is collected. Without candidates the classifier says no."""
    pieces = docs.select(F.explode(pieces_with_candidates(F.col(text))).alias("piece"))
    one = pieces.select(F.explode("piece.candidates").alias("c")).select("c.kind", "c.base", *[f"c.{name}" for name in LABELERS])
    bound = 2 * len(KINDS) * 3 ** len(LABELERS)
    patterns = collect_bounded(one.groupBy("kind", "base", *LABELERS).count(), bound).to_pandas()
    if not len(patterns):
        return SpanModel(np.full(len(LABELERS), 0.75), np.array([0.0] * (len(LABELERS) + len(KINDS) + 1) + [-10.0]))
    patterns = patterns.sort_values(["kind", "base", *LABELERS])
    votes, counts = patterns[list(LABELERS)].to_numpy(dtype="float64"), patterns["count"].to_numpy(dtype="float64")
    base = patterns["base"].to_numpy(dtype="float64")
    kinds = np.array([[float(k == kind) for kind in KINDS] for k in patterns["kind"]])
    group = (kinds.argmax(axis=1) * 2 + base).astype("int64")
    right, accuracy = expected_labels(votes, group, counts)
    features = np.column_stack([votes, kinds, base, np.ones(len(votes))])
    return SpanModel(accuracy, fit_logistic(features, right, 10 * np.log1p(counts)))  # rare patterns count too


def _accepted(model: SpanModel, candidates: Column) -> Column:
    return F.filter(candidates, lambda c: F.when(c["base"], True).otherwise(model.probability(c) >= 0.5))


def personal_data(docs: DataFrame, text: str = "text", model: SpanModel | None = None) -> DataFrame:
    """``docs`` with ``spans``: array of (start, order, stop, kind, base), by start and kind.

    A null text counts as empty and has no spans. Rows are handled each by itself, whatever their ids. An
    empty table gives an empty result. Columns of ``docs`` stay; one called ``spans`` becomes ``own_spans``.
    """
    chosen = model or train(docs, text)

    def moved(piece: Column) -> Column:
        fields = lambda c: [(c["start"] + piece["at"]).alias("start"), c["order"].alias("order"), (c["stop"] + piece["at"]).alias("stop")]
        return F.transform(
            _accepted(chosen, piece["candidates"]), lambda c: F.struct(*fields(c), c["kind"].alias("kind"), c["base"].alias("base"))
        )

    spans = F.flatten(F.transform(pieces_with_candidates(F.col(text)), moved))
    packed = docs.select(F.struct("*").alias("row"), spans.alias("spans"))
    return packed.select(*unpacked("row", own_names(docs.columns, ("spans",))), "spans")


def masked_text(text: Column, model: SpanModel) -> Column:
    """The text with every accepted span, overlapping ones together, replaced by its kind in square brackets.
    Null stays null."""
    parts = F.transform(pieces_with_candidates(text), lambda p: _once(_accepted(model, p["candidates"]), lambda s: masked(p["own"], s)))
    return F.when(text.isNotNull(), F.array_join(parts, ""))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with every span, overlapping ones together, replaced by its kind in square brackets."""
    nothing = F.expr("CAST(array() AS array<struct<start: int, stop: int, kind: string>>)")

    def merge(done: Column, s: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["stop"], s["stop"]).alias("stop"), last["kind"].alias("kind"))
        own = F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))
        overlaps = (F.size(done) > 0) & F.coalesce(s["start"] < last["stop"], F.lit(False))
        return F.when(overlaps, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(own)))

    apart = F.aggregate(spans, nothing, merge)
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def write(s: Column, span: Column) -> Column:
        piece = F.substring(text, s["at"] + 1, span["start"] - s["at"])
        return F.struct(span["stop"].alias("at"), F.concat(s["out"], piece, F.lit("["), F.upper(span["kind"]), F.lit("]")).alias("out"))

    whole = F.aggregate(apart, state, write, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
