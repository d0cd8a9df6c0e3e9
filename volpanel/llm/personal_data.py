"""Personal data in texts: fixed patterns, and further spans by weak supervision.

Further candidates (secrets, national ids, local phone numbers, IBANs) and the fixed ones are judged by four labelers
that vote yes (1), no (-1) or nothing (0): a strict pattern, a gazetteer of prefixes and domains, words in front of the
span, and its edges. Expectation-maximisation on the table of vote patterns - its size is bounded by the kinds and
votes - estimates how often each labeler is right and how likely each pattern is personal data. It is anchored: known
true spans stay true, and seed reliabilities keep their share of every estimate. A logistic span classifier is trained
on the result, with the votes, the length and digits of a span and the character before it as its features, and
decides which candidates become spans. Spans of the fixed patterns always stay.

Everything that touches texts is a DataFrame expression. Matches keep their places because a replacement puts a mark
around each of them, and a split at the marks leaves lengths to be added up.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volpanel.session import scratch_path

MARK, DOT, BLANK, OTHER = "\ue000", "\ue002", "\ue003", "\ue001"
CHUNK = 200
BASE = ("email", "ip", "card", "phone")
# The base patterns and their conditions on a match x. Runs are not tried again from inside, and a dot or
# blank that may stand between two characters of a match is replaced first, so that no pattern repeats a group: the
# regex engine's stack grows with repeated groups, and texts may be very long.
BETWEEN = {"email": ("(?<=[A-Za-z0-9-])[.](?=[A-Za-z0-9-])", DOT, "."), "card": ("(?<=[0-9])[ -](?=[0-9])", BLANK, " ")}
PATTERNS = {
    "email": rf"(?:\G|(?<![A-Za-z0-9._%+{DOT}-]))[A-Za-z0-9._%+{DOT}-]++@[A-Za-z0-9-]++{DOT}[A-Za-z0-9{DOT}-]++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": rf"[0-9][0-9{BLANK}]+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    "local_phone": r"(?<![0-9+(.-])\(?[2-9][0-9]{2}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|[0-9a-f]{32,64}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{20,})(?![A-Za-z0-9])",
}
# What follows a digit in every match that counts. One pattern over all of them, which begins with a class of characters
# and not with a look behind, tells most texts apart from those with such a match; it is read as the column ``digits``.
AFTER_DIGIT = {
    "ip": "[.][0-9]++[.][0-9]++[.][0-9]",
    "card": "(?:[ -]?[0-9]){15}",
    "iban": "[0-9][A-Z0-9]{11}",
    "local_phone": "[0-9]{2}[ .-][0-9]{4}",
    "national_id": "[0-9]{2}-[0-9]{2}-[0-9]{4}",
}
DIGITS = f"text rlike '[0-9](?:{'|'.join(AFTER_DIGIT.values())})'"
# A text that does not meet this condition holds no match that counts.
NEEDS = {
    "email": "contains(text, '@')",
    "phone": "contains(text, '+')",
    "secret": "contains(text, 'AKIA') OR contains(text, 'sk-') OR (contains(text, '_') AND text rlike 'gh[pousr]_') OR text rlike '[0-9a-f]{32}'",
} | {kind: f"digits AND text rlike '[0-9]{after}'" for kind, after in AFTER_DIGIT.items()}
LUHN = (
    "transform(array(reverse(translate(x, ' -', ''))), d -> length(d) BETWEEN 16 AND 19 AND aggregate(sequence(1, length(d)), 0, (a, i) -> a + "
    "CASE WHEN i % 2 = 1 THEN int(substr(d, i, 1)) WHEN int(substr(d, i, 1)) > 4 THEN 2 * int(substr(d, i, 1)) - 9 ELSE 2 * int(substr(d, i, 1)) END) % 10 = 0)[0]"
)
VALID = {
    "ip": r"x rlike '^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\\.|$)){4}$'",
    "card": f"length(x) >= 16 AND {LUHN}",
    "phone": "length(regexp_replace(x, '[^0-9]', '')) BETWEEN 8 AND 15",
}
# Labelers: condition for yes, condition for no, over x (the span), b (the 40 characters before it) and the next character n.
STRICT = {
    "email": (r"x rlike '^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\\.[A-Za-z]{2,24}$'", r"x rlike '\\.[0-9]+$'"),
    "ip": (r"x rlike '^[1-9][0-9]*\\.'", r"x rlike '^0\\.'"),
    "card": ("x rlike '^[3-6]'", "x rlike '^0'"),
    "phone": ("length(regexp_replace(x, '[^0-9]', '')) >= 10", "false"),
    "iban": ("x rlike '^[A-Z]{2}[0-9]{2}[A-Z]{0,4}[0-9]{7,}'", "x rlike '^[A-Z]+$'"),
    "local_phone": (r"x rlike '^\\(?[2-9][0-9]{2}\\)?[ -][2-9]'", r"x rlike '^[0-9]+\\.'"),
    "national_id": ("NOT x rlike '^(?:000|666|9)'", "x rlike '^(?:000|666|9)'"),
    "secret": ("x rlike '^AKIA' OR length(x) IN (32, 40, 64) OR x rlike '^(?:gh|sk-)'", "x rlike '^[0-9]+$'"),
}
GAZETTEER = {
    "email": r"x rlike '(?i)[@.](?:example|gmail|yahoo|hotmail|outlook|proton|gmx|web|icloud|mail)[.]'",
    "phone": r"x rlike '^\\+(?:1|7|20|27|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])'",
    "card": "translate(x, ' -', '') rlike '^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))'",
    "iban": "x rlike '^(?:AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)'",
    "secret": "x rlike '^(?:AKIA|gh[pousr]_|sk-)'",
}
CONTEXT = (
    "(?i)(?:mail|contact|call|phone|tel|mobile|fax|reach|address|server|host|card|visa|pay|iban|account|ssn|social|token|key|secret|password|=|:)[^a-z]{0,12}$"
)
AGAINST = "(?i)(?:version|isbn|doi|page|figure|table|section|commit|sha|md5|hash|build)[^a-z]{0,12}$"


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def without_marks(text: str) -> str:
    """The text with other signs for the marks, and null as an empty one; only odd texts are walked through."""
    odd = " OR ".join([f"NOT is_valid_utf8({text})", *(f"contains({text}, '{sign}')" for sign in (MARK, DOT, BLANK))])
    return f"CASE WHEN {text} IS NULL THEN '' WHEN {odd} THEN translate({text}, '{MARK}{DOT}{BLANK}', '{OTHER * 3}') ELSE {text} END"


def spans(kind: str) -> str:
    """Array of (kind, start, stop, x) of the matches of ``kind`` in ``text``, in order; bounded lists are summed blockwise.

    ``digits`` says whether the text meets ``DIGITS``.
    """
    between, sign, plain = BETWEEN.get(kind, ("", "", ""))
    held = f"regexp_replace(text, {quoted(between)}, '{sign}')" if between else "text"
    marked = f"regexp_replace({held}, {quoted(PATTERNS[kind])}, '{MARK}$0{MARK}')"
    if between:
        marked = f"translate({marked}, '{sign}', '{plain}')"
    marked = f"CASE WHEN {NEEDS[kind]} THEN {marked} ELSE '' END"
    steps = "transform(sequence(0, int((size(p) - 3) / 2)), i -> named_struct('gap', length(p[2 * i]), 'x', p[2 * i + 1]))"
    chunks = f"transform(sequence(0, int((size(s) - 1) / {CHUNK})), c -> slice(s, c * {CHUNK} + 1, {CHUNK}))"
    begins = (
        "aggregate(c, named_struct('at', 0, 'out', array_repeat(0, 0)), (a, k) -> named_struct('at', a.at + "
        "aggregate(k, 0, (n, e) -> n + e.gap + length(e.x)), 'out', array_append(a.out, a.at)), a -> a.out)"
    )
    empty = f"array_repeat(named_struct('kind', '{kind}', 'start', 0, 'stop', 0, 'x', ''), 0)"
    placed = (
        f"flatten(transform(c, (k, j) -> aggregate(k, named_struct('at', o[j], 'out', {empty}), (a, e) -> named_struct("
        "'at', a.at + e.gap + length(e.x), 'out', array_append(a.out, "
        f"named_struct('kind', '{kind}', 'start', a.at + e.gap, 'stop', a.at + e.gap + length(e.x), 'x', e.x))), a -> a.out)))"
    )
    body = f"transform(array({begins}), o -> {placed})[0]"
    body = f"transform(array({chunks}), c -> {body})[0]"
    body = f"transform(array({steps}), s -> {body})[0]"
    body = f"transform(array(split(m, '{MARK}', -1)), p -> {body})[0]"
    found = f"transform(array({marked}), m -> CASE WHEN instr(m, '{MARK}') = 0 THEN {empty} ELSE {body} END)[0]"
    if kind in VALID:
        found = f"filter({found}, e -> transform(array(e.x), x -> {VALID[kind]})[0])"
    return found


def votes() -> str:
    """The votes of the labelers on a span ``e`` of ``text``."""
    case = lambda table, i=None: "CASE e.kind " + " ".join(f"WHEN '{k}' THEN ({v if i is None else v[i]})" for k, v in table.items()) + " ELSE false END"
    vote = lambda yes, no: f"CASE WHEN {yes} THEN 1 WHEN {no} THEN -1 ELSE 0 END"
    inner = (
        f"named_struct('kind', e.kind, 'start', e.start, 'stop', e.stop, 'strict', {vote(case(STRICT, 0), case(STRICT, 1))}, "
        f"'gazetteer', {vote(case(GAZETTEER), 'false')}, "
        f"'context', {vote(f'b rlike {quoted(CONTEXT)}', f'b rlike {quoted(AGAINST)}')}, "
        "'edges', CASE WHEN b rlike '[A-Za-z0-9_]$' OR n rlike '^[A-Za-z0-9_@]' THEN -1 ELSE 1 END, "
        "'size', int(floor(log2(length(x)))), 'digits', int(4 * (length(x) - length(translate(x, '0123456789', ''))) / length(x)), "
        "'before', CASE WHEN b = '' THEN 0 WHEN b rlike '[\\\\p{L}\\\\p{N}]$' THEN 1 WHEN b rlike '[ \\\\t\\\\n]$' THEN 2 ELSE 3 END)"
    )
    inner = f"transform(array(e.x), x -> {inner})[0]"
    inner = f"transform(array(substr(text, e.stop + 1, 1)), n -> {inner})[0]"
    return f"transform(array(substr(text, greatest(1, e.start - 39), e.start - greatest(0, e.start - 40))), b -> {inner})[0]"


LABELERS = ("strict", "gazetteer", "context", "edges")
#: What the classifier reads of a span and of the character before it.
FEATURES = ("size", "digits", "before")
# How a labeler votes (no, nothing, yes) on false and on true spans before anything is estimated, and the
# share that this keeps in every estimate. The share does not shrink with the number of spans, so truth and falsehood
# cannot change places, and the same text has the same spans in a small and in a large corpus of its kind.
SEED = {0: {-1: 0.45, 0: 0.45, 1: 0.10}, 1: {-1: 0.05, 0: 0.35, 1: 0.60}}
SEED_PRIOR, SEED_SHARE = 0.5, 0.5


def reliabilities(patterns: list[tuple], anchors: tuple[str, ...] = ("card", "email"), rounds: int = 50) -> list[float]:
    """Probability of each vote pattern (kind, votes..., n) to be personal data, by expectation-maximisation.

    A labeler has, for either truth, its own shares of the votes; kinds have their own share of true spans. Spans of an
    anchor kind that its strict pattern confirms are known to be true: they have passed checks that chance does not.
    """
    kinds = np.array([p[0] for p in patterns])
    cast = np.array([p[1:-1] for p in patterns], int).reshape(len(patterns), len(LABELERS))
    n = np.array([p[-1] for p in patterns], float)
    known = np.isin(kinds, anchors) & (cast[:, 0] == 1)
    prior = dict.fromkeys(kinds.tolist(), SEED_PRIOR)
    shares = [{t: dict(SEED[t]) for t in SEED} for _ in LABELERS]
    post = np.zeros(len(patterns))
    for _ in range(rounds):
        odds = np.array([math.log(prior[k] / (1 - prior[k])) for k in kinds.tolist()])
        for j, table in enumerate(shares):
            odds += np.array([math.log(table[1][v] / table[0][v]) for v in cast[:, j].tolist()])
        post = np.where(known, 1.0, 1 / (1 + np.exp(-np.clip(odds, -30, 30))))
        for k in prior:
            own = kinds == k
            prior[k] = SEED_SHARE * SEED_PRIOR + (1 - SEED_SHARE) * float((post * n)[own].sum() / n[own].sum())
        for j, table in enumerate(shares):
            for truth, weight in ((1, post * n), (0, (1 - post) * n)):
                for vote in (-1, 0, 1):
                    seen = float(weight[cast[:, j] == vote].sum() / weight.sum()) if weight.sum() > 0 else SEED[truth][vote]
                    table[truth][vote] = SEED_SHARE * SEED[truth][vote] + (1 - SEED_SHARE) * seen
    return post.tolist()


def classifier(rows: list[tuple], post: list[float], steps: int = 400, rate: float = 1.0) -> tuple[float, dict[tuple[str, object], float]]:
    """Logistic weights of (name, value) for kind, votes and features, fitted to the probabilities of the rows.

    Rows end with their number. Every kind of span weighs as much as any other one, so frequent kinds do not drown rare
    ones.
    """
    columns = ("kind", *LABELERS, *FEATURES)
    names = sorted({(name, v) for r in rows for name, v in zip(columns, r[:-1])}, key=str)
    place = {name: i for i, name in enumerate(names)}
    spots = np.array([[place[name, v] for name, v in zip(columns, r[:-1])] for r in rows], int).reshape(len(rows), len(columns))
    n, kinds, q = np.array([r[-1] for r in rows], float), np.array([r[0] for r in rows]), np.array(post)
    for k in set(kinds.tolist()):
        n[kinds == k] /= n[kinds == k].sum() * len(set(kinds.tolist()))
    weights, bias = np.zeros(len(names)), 0.0
    for _ in range(steps):
        error = (q - 1 / (1 + np.exp(-np.clip(bias + weights[spots].sum(axis=1), -30, 30)))) * n
        step = np.bincount(spots.reshape(-1), np.repeat(error, len(columns)), len(names)) if len(rows) else weights
        bias += rate * float(error.sum())
        weights += rate * (step - 1e-4 * weights)
    return bias, dict(zip(names, weights.tolist()))


def find_personal_data(docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = 0.5, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: ``base`` (kind, start, stop) of the fixed patterns and ``spans`` (all, with a probability).

    Places are code points, stop exclusive; spans are sorted by kind - the fixed ones first, in their order, then the
    others by name - and start. Columns named in ``keep`` come along as one column ``row``. A candidate of another kind that overlaps a base span is dropped. Null and empty texts
    have no spans; repeated rows are searched one by one.
    """
    spark = docs.sparkSession
    row = F.struct(*keep) if keep else F.lit(None).cast("int")
    source = docs.select(row.alias("row"), F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    source = source.selectExpr("row", "id", f"{without_marks('text')} AS text")
    found = source.selectExpr("row", "id", "text", f"{DIGITS} AS digits").selectExpr("row", "id", "text", *[f"{spans(k)} AS {k}" for k in PATTERNS])
    judged = found.selectExpr("row", "id", f"transform(concat({', '.join(PATTERNS)}), e -> {votes()}) AS spans")
    path = scratch_path(spark, "candidates")
    judged.write.parquet(path)
    stored = spark.read.parquet(path)
    # bounded by kinds, votes and values of the features
    counted = stored.select(F.inline("spans")).groupBy("kind", *LABELERS, *FEATURES).agg(F.count("*").alias("n"))
    rows = sorted(tuple(r) for r in counted.collect())
    votes_of = {}
    for r in rows:
        votes_of[r[: 1 + len(LABELERS)]] = votes_of.get(r[: 1 + len(LABELERS)], 0) + r[-1]
    patterns = sorted((*p, n) for p, n in votes_of.items())
    truth = {p[:-1]: q for p, q in zip(patterns, reliabilities(patterns))}
    bias, weights = classifier(rows, [truth[r[: 1 + len(LABELERS)]] for r in rows])
    terms = []
    for name in ("kind", *LABELERS, *FEATURES):
        values = [(v, w) for (n, v), w in weights.items() if n == name]
        if values:
            literal = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
            terms.append(f"CASE e.{name} " + " ".join(f"WHEN {literal(v)} THEN {w!r}D" for v, w in values) + " ELSE 0D END")
    score = f"1 / (1 + exp(-({reduce(lambda a, b: f'{a} + {b}', terms, f'{bias!r}D')})))"
    own = ", ".join(f"'{k}'" for k in BASE)
    scored = stored.selectExpr(
        "row",
        "id",
        f"filter(spans, e -> e.kind IN ({own})) AS base",
        f"transform(spans, e -> named_struct('kind', e.kind, 'start', e.start, 'stop', e.stop, 'probability', {score})) AS spans",
    )
    return scored.selectExpr(
        *["row"] * bool(keep),
        f"id AS {id}",
        "transform(base, e -> named_struct('kind', e.kind, 'start', e.start, 'stop', e.stop)) AS base",
        f"filter(spans, e -> e.kind IN ({own}) OR (e.probability >= {threshold} AND NOT exists(base, o -> o.start < e.stop AND e.start < o.stop))) AS spans",
    )


def listed(spans: str) -> str:
    """kind:start:stop of all spans, comma-joined."""
    return f"array_join(transform({spans}, e -> concat(e.kind, ':', e.start, ':', e.stop)), ',')"


def redacted(text: str, spans: str) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans are one gap."""
    return (
        f"transform(array(coalesce({text}, '')), t -> aggregate(array_sort(transform({spans}, e -> named_struct('start', e.start, 'stop', e.stop, 'kind', e.kind))), "
        "named_struct('at', 0, 'out', ''), (a, e) -> CASE WHEN e.stop <= a.at THEN a ELSE named_struct('at', e.stop, 'out', "
        "concat(a.out, substr(t, a.at + 1, greatest(0, e.start - a.at)), '<', e.kind, '>')) END, a -> concat(a.out, substr(t, a.at + 1))))[0]"
    )
