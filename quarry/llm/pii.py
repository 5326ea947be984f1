"""Personal data by candidate gradient boosting (native expressions only).

Base detectors (e-mail, IP, card, phone) give spans that always stand. On top,
high-recall generators propose overlapping candidate spans (obfuscated or
loosely formatted variants), and a model alone decides which of them are added. It sees how
a candidate is written (binned format features and its neighbours); it is taught by what
it does not see: candidates that hit a base span or are ``proven`` by an independent check
(Luhn, octets, words right before them) are labelled, the rest is unlabelled, not negative.
Trees of depth TREE_DEPTH are boosted on the counts of all feature vectors over all documents
(one aggregate; the bins bound their number). Scores of each of FOLDS parts come from the other
parts; on them the share of positives that are labelled is estimated from the labelled
ones, so an unlabelled vector counts by its chance to be a positive, and a kind's threshold is
the least at which PRECISION of the selected are expected to be positives. So a way of writing
that is often proven is also added where no check is at hand. The fitted
model is a plain expression, so scoring is one scan without shuffles.

Defined results: null and empty texts have no spans; spans are in code points,
end exclusive; equal spans of one kind count once; a kind without a labelled candidate
in all documents adds nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
ROUNDS, RATE, PRECISION, FOLDS, TREE_DEPTH = 30, 0.4, 0.99, 5, 3
_LOCAL = r"[A-Za-z0-9._%+-]"
# A run of the first class is entered at its start only (or where the previous
# match ended): the same matches as without, but linear on long runs. The last
# group is possessive: nothing follows it, and it then needs no stack per label.
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
CARD_BREAK = r"[^0-9]{2,}|[^0-9\x20-]"       # what stands between runs of digits with single separators
_OCTET = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
GENERATORS = {
    "email": rf"{_LOCAL}{{1,64}} ?(?:@|[(\[]at[)\]]) ?[A-Za-z0-9-]{{1,63}}(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]{{1,63}}){{1,8}}",
    "ip": r"[0-9]{1,4}(?:[.,:][0-9]{1,4}){3}",
    "card": r"[0-9](?:[ .-]?[0-9]){12,18}",
    "phone": r"\(?[+0-9][0-9 ().-]{6,20}[0-9]",
}
#: A cheap test without which a pattern cannot match.
NEEDS = {"email": r"@|[(\[]at[)\]]", "ip": r"[0-9][.,:][0-9]", "card": r"[0-9][ .-]?[0-9][ .-]?[0-9][ .-]?[0-9]",
         "phone": r"[0-9][0-9 ().-]{4}"}
#: Words right before a span that name its kind.
NAMED = {"email": r"(?i)\b(?:e-?mail|mail|contact)(?: (?:is|at|to))?[^A-Za-z0-9]{0,3}$",
         "ip": r"(?i)\b(?:ip|ipv4|ip address|address|host|server)(?: (?:is|at))?[^A-Za-z0-9]{0,3}$",
         "phone": r"(?i)\b(?:call|phone|tel|telephone|fax|mobile|contact)(?: (?:is|at|us|me|us at|me at))?[^A-Za-z0-9]{0,3}$"}
CARD_GROUPS = r"^[0-9]+$|^[0-9]{3,6}([ .-])[0-9]{3,6}(?:\1[0-9]{1,6})+$"      # one kind of separator
SPELT = r"[(\[]at[)\]].*(?:\.|[(\[]dot[)\]])"
SPAN = "array<struct<start:bigint,stop:bigint,txt:string>>"


def _none() -> Column:
    return F.from_json(F.lit("[]"), SPAN)


def _places(text: Column, pattern: str) -> Column:
    """All matches with their code point positions: the pieces between matches and
    the matches alternate, so running lengths give the starts."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), _none().alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["gap"])
        stop = start + F.char_length(x["hit"])
        span = F.struct(start.alias("start"), stop.alias("stop"), x["hit"].alias("txt"))
        return F.struct(stop.alias("at"), F.array_append(acc["out"], span).alias("out"))
    both = F.transform(found, lambda m, i: F.struct(F.get(pieces, i).alias("gap"), m.alias("hit")))
    return F.aggregate(both, zero, step)["out"]


def _digits(txt: Column) -> Column:
    return F.regexp_replace(txt, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.char_length(digits)
    value = lambda i: F.substr(digits, n - i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + F.when(
        i % 2 == 0, value(i)).otherwise(value(i) * 2 - F.when(value(i) > 4, 9).otherwise(0)))
    return (n > 0) & (total % 10 == 0)


def _card_runs(text: Column) -> Column:
    """Maximal runs ``[0-9]([ -]?[0-9])+``: the pieces between breaks without a
    separator at either end."""
    gaps = F.regexp_extract_all(text, F.lit(CARD_BREAK), F.lit(0))
    pieces = F.split(text, CARD_BREAK, -1)
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), _none().alias("out"))

    def step(acc: Column, x: Column) -> Column:
        lead = F.when(x["run"].rlike(r"^[\x20-]"), 1).otherwise(0)
        bare = F.regexp_replace(x["run"], r"^[\x20-]|[\x20-]$", "")
        start = acc["at"] + lead
        span = F.struct(start.alias("start"), (start + F.char_length(bare)).alias("stop"), bare.alias("txt"))
        held = F.char_length(bare).between(16, 37)
        return F.struct((acc["at"] + F.char_length(x["run"]) + F.char_length(x["gap"])).alias("at"),
                        F.when(held, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))
    both = F.transform(pieces, lambda p, i: F.struct(p.alias("run"), F.coalesce(F.get(gaps, i), F.lit("")).alias("gap")))
    return F.aggregate(both, zero, step)["out"]


def base_spans(text: Column) -> dict[str, Column]:
    """Valid base matches per kind (leftmost, non-overlapping; failing ones dropped)."""
    seen = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"),
            "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), "phone": text.contains("+")}
    places = {"email": _places(text, EMAIL), "ip": _places(text, IP), "card": _card_runs(text),
              "phone": _places(text, PHONE)}
    n = lambda s: F.char_length(_digits(s["txt"]))
    valid = {"email": lambda s: F.lit(True),
             "ip": lambda s: F.forall(F.split(s["txt"], r"\."), lambda p: p.rlike(_OCTET)),
             "card": lambda s: n(s).between(16, 19) & luhn(_digits(s["txt"])),
             "phone": lambda s: n(s).between(8, 15)}
    return {k: F.when(seen[k], F.filter(places[k], valid[k])).otherwise(_none()) for k in KINDS}


# --- candidates and the boosted model ------------------------------------------------

FEATURES = ("digits", "marks", "length", "head", "before", "after", "check", "parts", "spelt")


def _char_class(c: Column) -> Column:
    return (F.when(c == "", 0).when(c.rlike(r"^[\x20\x09-\x0D]$"), 1).when(c.rlike("^[0-9]$"), 2)
            .when(c.rlike(r"^\p{L}$"), 3).otherwise(4))


def _features(text: Column, s: Column) -> dict[str, Column]:
    txt, digits = s["txt"], _digits(s["txt"])
    before = F.when(s["start"] > 0, F.substr(text, s["start"].cast("int"), F.lit(1))).otherwise(F.lit(""))
    n, size = F.char_length(digits), F.char_length(txt)
    steps = lambda c, *at: reduce(lambda x, y: x + y, [(c >= v).cast("int") for v in at])
    return {"digits": steps(n, 1, 8, 10, 13, 16, 20),
            "marks": F.least(F.char_length(F.regexp_replace(txt, "[A-Za-z0-9]", "")), F.lit(4)),
            "length": steps(size, 8, 16, 32),
            "head": F.when(txt.startswith("+"), 3).when(txt.startswith("("), 2).when(txt.rlike("^[0-9]"), 1).otherwise(0),
            "before": _char_class(before),
            "after": _char_class(F.substr(text, (s["stop"] + 1).cast("int"), F.lit(1))),
            "check": F.when(digits != "", luhn(digits).cast("int")).otherwise(0),
            "parts": F.forall(F.filter(F.split(txt, "[^0-9]+"), lambda p: p != ""), lambda p: p.rlike(_OCTET)).cast("int"),
            "spelt": F.when(txt.rlike(SPELT), 2).when(txt.rlike(r"[A-Za-z]{2,24}$"), 1).otherwise(0)}


def proven(kind: str, text: Column, s: Column) -> Column:
    """Whether a candidate passes a check that does not come from the base detectors.
    Digits right before or after it: it is a piece of something longer."""
    txt, n = s["txt"], F.char_length(_digits(s["txt"]))
    first = F.greatest(s["start"] - 24, F.lit(0))
    lead = F.substr(text, (first + 1).cast("int"), (s["start"] - first).cast("int"))
    after = F.substr(text, (s["stop"] + 1).cast("int"), F.lit(2))
    apart = ~lead.rlike(r"[0-9][.,:]?$") & ~after.rlike("^[.,:]?[0-9]")
    if kind == "email":
        return txt.rlike(r"[A-Za-z]{2,24}$") & (txt.rlike(SPELT) | lead.rlike(NAMED[kind]))
    if kind == "card":
        return apart & n.between(13, 19) & luhn(_digits(txt)) & txt.rlike("[1-9]") & txt.rlike(CARD_GROUPS)
    if kind == "ip":
        return apart & F.forall(F.split(txt, "[.,:]"), lambda p: p.rlike(_OCTET)) & lead.rlike(NAMED[kind])
    return apart & n.between(8, 15) & (lead.rlike(NAMED[kind]) | txt.rlike(r"^\([0-9]{2,4}\) ?[0-9]"))


def _bare(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop")))


def _of_kind(kind: str, text: Column, base: Column) -> Column:
    spans = F.when(text.rlike(NEEDS[kind]), _places(text, GENERATORS[kind])).otherwise(_none())
    return F.transform(spans, lambda s: F.struct(
        F.lit(kind).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"),
        F.exists(base, lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])).alias("hit"),
        proven(kind, text, s).alias("proven"),
        *[c.cast("int").alias(f) for f, c in _features(text, s).items()]))


def candidates(text: Column, base: dict[str, Column]) -> Column:
    """All generators' spans as ``kind, start, stop, hit, proven`` and the features."""
    return F.concat(*[_of_kind(k, text, base[k]) for k in KINDS])


def fit(docs: DataFrame) -> dict[str, dict]:
    """Per kind: trees, bias and threshold, from counts over all candidates of all documents."""
    text = F.coalesce(F.col("text"), F.lit(""))
    spans = docs.select(F.pmod(F.xxhash64("text"), F.lit(FOLDS)).alias("fold"), text.alias("text"))
    based = spans.select("fold", "text", *[c.alias(k) for k, c in base_spans(F.col("text")).items()])
    rows = based.select("fold", F.explode(candidates(F.col("text"), {k: F.col(k) for k in KINDS})).alias("c"))
    counts = (rows.groupBy("c.kind", "fold", *[F.col(f"c.{f}") for f in FEATURES])
              .agg(F.sum((F.col("c.hit") | F.col("c.proven")).cast("bigint")).alias("pos"), F.count(F.lit(1)).alias("n"))
              .orderBy("kind", "fold", *FEATURES).collect())          # bounded by the features' bins
    models = {}
    for k in KINDS:
        own = [r for r in counts if r["kind"] == k]
        if sum(r["pos"] for r in own):
            models[k] = _model(np.array([[r[f] for f in FEATURES] for r in own]), np.array([r["pos"] for r in own], float),
                               np.array([r["n"] for r in own], float), np.array([r["fold"] for r in own]))
    return models


def _model(x: np.ndarray, pos: np.ndarray, n: np.ndarray, fold: np.ndarray) -> dict:
    score = np.zeros(len(x))
    for f in range(FOLDS):
        out = fold == f
        if out.any():
            score[out] = _scores(_boost(x[~out], pos[~out], n[~out]), x[out])
    return _boost(x, pos, n) | {"threshold": _threshold(score, pos, n)}


def _splits(x: np.ndarray) -> list[tuple[int, int]]:
    return [(f, int(cut)) for f in range(x.shape[1]) for cut in np.unique(x[:, f])[:-1]]


def _grow(x, grad, hess, splits, below, depth) -> tuple | float:
    """A tree ``(feature, at most, tree if so, tree else)``; a leaf is its value."""
    g, h = grad.sum(), hess.sum()
    if depth and splits:
        left_g, left_h = below @ grad, below @ hess
        gain = left_g ** 2 / (left_h + 1) + (g - left_g) ** 2 / (h - left_h + 1) - g ** 2 / (h + 1)
        best = int(np.argmax(np.round(gain, 9)))                       # the first of equal gains
        if gain[best] > 1e-9:
            on = below[best]
            return (*splits[best], *[_grow(x, grad * side, hess * side, splits, below, depth - 1) for side in (on, ~on)])
    return float(RATE * g / (h + 1))


def _tree_value(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, cut, yes, no = tree
    return np.where(x[:, f] <= cut, _tree_value(yes, x), _tree_value(no, x))


def _boost(x: np.ndarray, pos: np.ndarray, n: np.ndarray) -> dict:
    """Boosted trees on counted vectors: ``pos`` labelled of ``n``."""
    bias = math.log((pos.sum() + 1) / (n.sum() - pos.sum() + 1))
    splits = _splits(x) if len(x) else []
    below = np.array([x[:, f] <= cut for f, cut in splits]) if splits else None
    trees, score = [], np.full(len(x), bias)
    for _ in range(ROUNDS if splits else 0):
        q = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        trees.append(_grow(x, pos - n * q, n * q * (1 - q) + 1e-9, splits, below, TREE_DEPTH))
        score = score + _tree_value(trees[-1], x)
    return {"trees": trees, "bias": bias}


def _scores(model: dict, x: np.ndarray) -> np.ndarray:
    return reduce(lambda s, t: s + _tree_value(t, x), model["trees"], np.full(len(x), model["bias"]))


def _threshold(score: np.ndarray, pos: np.ndarray, n: np.ndarray) -> float:
    """The least score from which on PRECISION of the vectors' candidates are expected to be positives."""
    q = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    known = (q * pos).sum() / pos.sum()                                # share of positives that are labelled
    hits = pos + (n - pos) * np.minimum(1.0, (1 - known) / max(known, 1e-9) * q / (1 - q))
    levels, at = np.unique(-score, return_inverse=True)                # equal scores are taken together
    hits, seen = (np.cumsum(np.bincount(at, v)) for v in (hits, n))
    good = np.flatnonzero(hits >= PRECISION * seen)
    return float(-levels[good[-1]]) if len(good) else math.inf


def _tree_column(tree, c: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(tree)
    f, cut, yes, no = tree
    return F.when(c[FEATURES[f]] <= cut, _tree_column(yes, c)).otherwise(_tree_column(no, c))


def _chosen(c: Column, models: dict[str, dict]) -> Column:
    """Whether the model of a candidate's kind adds it."""
    out = F.lit(False)
    for k, m in models.items():
        if m["threshold"] < math.inf:
            score = reduce(lambda a, b: a + b, [_tree_column(t, c) for t in m["trees"]], F.lit(m["bias"]))
            out = out | ((c["kind"] == k) & (score >= F.lit(m["threshold"] - 1e-9)))
    return out & ~c["hit"]


def detect(docs: DataFrame, models: dict[str, dict] | None = None) -> DataFrame:
    """``doc_id, text`` and ``email, ip, card, phone`` (base spans ``start, stop``) and
    ``added`` (``kind, start, stop``), one row per row of ``docs``."""
    models = fit(docs) if models is None else models
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", *[c.alias(k) for k, c in base_spans(F.col("text")).items()])
    picked = F.filter(candidates(F.col("text"), {k: F.col(k) for k in KINDS}), lambda c: _chosen(c, models))
    added = F.array_distinct(F.transform(picked, lambda c: F.struct(
        c["kind"].alias("kind"), c["start"].alias("start"), c["stop"].alias("stop"))))
    return rows.select("doc_id", "text", *KINDS, added.alias("added"))


def _listed(kind: str, spans: Column) -> Column:
    return F.transform(F.array_sort(_bare(spans)), lambda s: F.concat_ws(
        ":", F.lit(kind), s["start"].cast("string"), s["stop"].cast("string")))


def listed(cols: dict[str, Column]) -> Column:
    """``kind:start:end`` comma-joined, kinds in order, then by start."""
    return F.array_join(F.concat(*[_listed(k, c) for k, c in cols.items()]), ",")


def _with_added(kind: str) -> Column:
    return F.concat(_bare(F.col(kind)), _bare(F.filter("added", lambda a: a["kind"] == kind)))


def all_spans() -> dict[str, Column]:
    """Base and added spans per kind of ``detect``'s rows."""
    return {k: _with_added(k) for k in KINDS}


def _tagged(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"),
                                                 F.lit(kind).alias("kind")))


def redact(found: DataFrame) -> DataFrame:
    """``detect``'s rows with ``redacted``: every span (overlapping ones from the first
    start) replaced by its kind in brackets."""
    tagged = F.concat(*[_tagged(k, c) for k, c in all_spans().items()])
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substr(F.col("text"), (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        mark = F.when(s["start"] >= acc["at"], F.concat(gap, F.lit("["), s["kind"], F.lit("]"))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.concat(acc["out"], mark).alias("out"))
    done = F.aggregate(F.array_sort(tagged), zero, step)
    tail = F.substr(F.col("text"), (done["at"] + 1).cast("int"), F.char_length("text"))
    return found.withColumn("redacted", F.concat(done["out"], tail))
