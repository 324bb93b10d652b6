"""Personal data by weak supervision, in DataFrame functions only.

Regexes find candidate spans; four labelers vote on each (1 yes, -1 no, 0 abstains): the format's own check, a gazetteer
(top-level domains, card issuers, country codes, reserved addresses), cue words in the CONTEXT characters before, and what
touches the span. Expectation-maximisation over the counts of vote patterns estimates each labeler's reliability for each
kind, from a prior that is stated in ERRS; the posteriors, as soft labels, train a logistic span classifier that sees the
votes and, besides them, the span's length and separators, its neighbours and how near a cue is. Spans that pass the base
rules always stay; the classifier decides on the other candidates.

The driver receives only counts of what FEATURES can tell apart, at most 81 x 1,875 rows a kind and in practice some hundred.
Matches are leftmost and don't overlap within a kind; their places are running sums of the lengths of what lies between and in
them, in as many passes as their number has binary digits, so the cost of a text is its length times a logarithm, however many
matches there are. The regexes use possessive forms and start only where a run starts, which gives the same matches without
going back over runs. Numbers of too few or too many digits for a card or a phone aren't candidates of these kinds.

Defined results: null texts have no spans; with no candidates at all nothing is learned and only base spans are found; ties
in place are ordered by kind as listed in KINDS. Rows are independent once the model is fitted; extra columns are ignored by
`find` and kept by `redact`.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import let, running

KINDS = ("email", "ip", "card", "phone", "ssn")
BASE_KINDS = KINDS[:4]
LABELERS = ("format", "gazetteer", "context", "edges")
CONTEXT = 24
#: What expectation-maximisation believes before it sees votes: how often a labeler that votes is wrong (a format's check, being a
#: checksum or a range, hardly ever), and for how many candidates that counts: so many, and so large a share of all of a kind.
ERRS = {"format": 0.002, "gazetteer": 0.25, "context": 0.2, "edges": 0.3}
PRIOR_ROWS, PRIOR_SHARE = 4.0, 0.5
#: What the classifier sees of a candidate, as small numbers: a labeler's vote (0 no, 1 abstains, 2 yes); the span's length; the
#: separators in it (none, blank, hyphen, point, several); what stands before and after it (an end, a blank, a letter, a digit,
#: other); how near a cue word is.
FEATURES = {**dict.fromkeys(LABELERS, 3), "long": 5, "apart": 5, "left": 5, "right": 5, "near": 3}
#: Lengths at which the next class of `long` begins, and the last characters within which a cue is near.
LONG, NEAR = (9, 13, 17, 25), 8
#: Code points of the pieces in which a text is cut for redaction.
PIECE = 512

#: Fixed patterns of the candidates: name, kind, a cheap test that a text needs, the pattern.
PATTERNS = (
    ("email", "email", "@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", "ip", "[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", "card", "[0-9]", r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", "phone", "+", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ("email spelled", "email", "[at]", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++ ?\[at\] ?[A-Za-z0-9-]++(?: ?(?:\[dot\]|\.) ?[A-Za-z0-9-]++)++"),
    ("phone grouped", "phone", "+", r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"),
    ("phone local", "phone", "[0-9]", r"(?<![0-9+.() -])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    ("ssn", "ssn", "[0-9]", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
)
#: Fixed gazetteers and cue words.
DOMAINS = "com|org|net|edu|gov|mil|int|info|io|de|fr|es|uk|it|nl|eu|ch|at|us|ca|au|jp|cn|in|br|mx"
ISSUERS = "4|5[1-5]|2[2-7]|3[4-9]|30[0-5]|6011|64[4-9]|65|62"
COUNTRY_CODES = "1|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58]"
CUES = {
    "email": "mail|contact|write|address|correo|courriel",
    "ip": "ip|host|server|address|login|from",
    "card": "card|visa|credit|pay|karte|carte|tarjeta",
    "phone": "phone|call|tel|fax|mobile|contact|rufen",
    "ssn": "ssn|social|security",
}
AGAINST = "version|isbn|issn|invoice|order|section|figure|page|doi"

_ITEM = "struct<kind:string,rank:int,s:int,e:int,base:boolean," + ",".join(f"{n}:int" for n in FEATURES) + ">"


def _votes(kind: str, name: str, m: Column, before: Column, after: Column) -> tuple[Column, Column, Column, Column, Column]:
    """Whether the base rules hold, and the labelers' votes."""
    yes, no, none = F.lit(1), F.lit(-1), F.lit(0)
    digits = F.translate(m, "+ ().-", "")
    if name == "email":
        base, gazetteer = F.lit(True), F.when(F.lower(m).rlike(rf"\.(?:{DOMAINS})$"), yes).otherwise(no)
    elif name == "ip":
        base = m.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9][0-9]?)(?:\.|$)){4}$")
        gazetteer = F.when(m.rlike(r"^0*(?:0|127|255)\.|\.0+$"), no).otherwise(yes)
    elif name == "card":
        base = F.length(digits).between(14, 19) & F.when(F.length(digits).between(14, 19), F.call_function("luhn_check", digits)).otherwise(False)
        gazetteer = F.when(digits.rlike(f"^(?:{ISSUERS})") & F.length(digits).between(14, 19), yes).otherwise(no)
    elif name in ("phone", "phone grouped"):
        base, gazetteer = F.length(digits).between(10, 15) if name == "phone" else F.lit(False), F.when(digits.rlike(f"^(?:{COUNTRY_CODES})"), yes).otherwise(no)
    elif name == "ssn":
        base, gazetteer = F.lit(False), F.when(m.rlike(r"^(?:000|666|9)|-00-|-0000$"), no).otherwise(yes)
    else:
        base, gazetteer = F.lit(False), none
    checked = name in BASE_KINDS and name != "email"
    format_vote = F.when(base, yes).otherwise(no) if checked else F.when(base, yes).otherwise(none)
    near = F.lower(before)
    context = F.when(near.rlike(rf"\b(?:{AGAINST})\b"), no).when(near.rlike(rf"\b(?:e-?)?(?:{CUES[kind]})\w*\b"), yes).otherwise(none)
    edges = F.when(F.substr(before, F.length(before), F.lit(1)).rlike(r"[\p{L}0-9]") | after.rlike(r"[\p{L}0-9]"), no).otherwise(yes)
    return base, format_vote, gazetteer, context, edges


def _digits(m: Column) -> Column:
    return F.length(F.regexp_replace(m, "[^0-9]", ""))


def _beside(c: Column) -> Column:
    """The class of the character beside a span."""
    return F.when(F.coalesce(c, F.lit("")).isin("", "\n"), 0).when(c.rlike(r"^\s"), 1).when(c.rlike(r"^\p{L}"), 2).when(c.rlike("^[0-9]"), 3).otherwise(4)


def _seen(kind: str, name: str, m: Column, before: Column, after: Column) -> tuple[Column, dict[str, Column]]:
    """Whether the base rules hold, and the features."""
    base, *votes = _votes(kind, name, m, before, after)
    marks = F.translate(m, "0123456789()+", "")
    apart = F.when(marks == "", 0).when(F.trim(marks) == "", 1).when(F.translate(marks, "-", "") == "", 2).when(F.translate(marks, ".", "") == "", 3).otherwise(4)
    long = sum((F.length(m) >= n).cast("int") for n in LONG)
    cue = rf"\b(?:e-?)?(?:{CUES[kind]})\w*\b"
    near = F.when(F.lower(F.substring(before, -NEAR, NEAR)).rlike(cue), 2).when(F.lower(before).rlike(cue), 1).otherwise(0)
    told = {n: v + 1 for n, v in zip(LABELERS, votes, strict=True)}
    return base, told | {"long": long, "apart": apart, "left": _beside(F.substring(before, -1, 1)), "right": _beside(after), "near": near}


def _placed(matched: Column, between: Column, name: str, kind: str) -> Column:
    """The candidates of one pattern with their places, from its matches and the texts between them; null where neither is."""

    def cut(ends: Column) -> Column:
        return F.transform(matched, lambda m, i: F.struct(m.alias("m"), F.substring(F.get(between, i), -CONTEXT, CONTEXT).alias("before"), F.substring(F.get(between, i + 1), 1, 1).alias("after"), F.get(ends, i).alias("e")))

    def describe(x: Column) -> Column:
        base, told = _seen(kind, name, x["m"], x["before"], x["after"])
        return F.struct(F.lit(kind).alias("kind"), F.lit(KINDS.index(kind)).alias("rank"), (x["e"] - F.length(x["m"])).alias("s"), x["e"].alias("e"), base.alias("base"), *[v.cast("int").alias(n) for n, v in told.items()]).cast(_ITEM)

    sizes = F.transform(matched, lambda m, i: F.length(F.get(between, i)) + F.length(m))
    found = let(running(sizes, lambda a, b: a + b), cut)
    if name in ("card", "phone"):
        least, most = (12, 21) if name == "card" else (7, 1 << 30)
        found = F.filter(found, lambda x: _digits(x["m"]).between(least, most))
    return F.when(F.size(matched) > 0, F.transform(found, describe))


def with_candidates(docs: DataFrame, text_col: str, out_col: str) -> DataFrame:
    """docs with the candidate spans of the text in out_col, unsorted: (kind, rank, s, e, base, features)."""
    names = docs.columns
    text = F.coalesce(F.col(text_col), F.lit(""))
    cut = {}
    for k, (_, _, needs, pattern) in enumerate(PATTERNS):
        there = text.rlike("[0-9]") if needs == "[0-9]" else F.contains(text, F.lit(needs))
        cut |= {f"between {k} {out_col}": F.when(there, F.split(text, pattern, -1)), f"matched {k} {out_col}": F.when(there, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))}
    rows = docs.withColumns(cut)
    arrays = [F.coalesce(_placed(F.col(f"`matched {k} {out_col}`"), F.col(f"`between {k} {out_col}`"), name, kind), F.array().cast(f"array<{_ITEM}>")) for k, (name, kind, _, _) in enumerate(PATTERNS)]
    return rows.withColumn(out_col, F.concat(*arrays)).select(*names, out_col)


def estimate(patterns: list[tuple], rounds: int = 200) -> dict[str, dict[tuple, float]]:
    """Posterior of each vote pattern, for each kind: (kind, votes, count) rows in, votes as 0 no, 1 abstains, 2 yes.

    Expectation-maximisation of a mixture of two classes in which labelers vote independently, under Dirichlet priors whose
    means say by ERRS how often a vote is wrong; it ends when no posterior moves by 1e-9.
    """
    out = {}
    for kind in KINDS:
        rows = [(votes, n) for k, votes, n in patterns if k == kind]
        if not rows:
            continue
        votes, n = np.array([v for v, _ in rows]), np.array([c for _, c in rows], float)
        told = np.stack([votes == v for v in range(3)], axis=-1).astype(float)  # pattern, labeler, vote
        strength = PRIOR_ROWS + PRIOR_SHARE * n.sum()
        says = (n @ told.reshape(len(n), -1)).reshape(-1, 3) / n.sum()
        prior = np.empty((2, len(LABELERS), 3))  # class (0 yes, 1 no), labeler, vote
        for j, name in enumerate(LABELERS):
            for y, right in ((0, 2), (1, 0)):
                prior[y, j, 1] = says[j, 1]
                prior[y, j, right], prior[y, j, 2 - right] = (1 - ERRS[name]) * (1 - says[j, 1]), ERRS[name] * (1 - says[j, 1])
        rate, share, post = prior + 1e-9, 0.5, np.full(len(n), 0.5)
        for _ in range(rounds):
            odds = np.log(share / (1 - share)) + (told * np.log(rate[0] / rate[1])).sum(axis=(1, 2))
            before, post = post, 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            if np.abs(post - before).max() < 1e-9:
                break
            mass = np.stack((n * post, n * (1 - post)))
            share = (mass[0].sum() + PRIOR_ROWS / 2) / (n.sum() + PRIOR_ROWS)
            rate = (np.einsum("yp,pjv->yjv", mass, told) + strength * prior + 1e-9) / (mass.sum(axis=1)[:, None, None] + strength + 3e-9)
        out[kind] = {v: float(p) for (v, _), p in zip(rows, post, strict=True)}
    return out


def train(patterns: list[tuple], posterior: dict[str, dict[tuple, float]], rounds: int = 50, penalty: float = 0.1) -> dict[str, tuple[float, dict[str, list[float]]]]:
    """For each kind the classifier's bias and its weights by feature and value, from (kind, features, count) rows.

    The soft label of a row is the posterior of its votes; Newton steps reach the one least point of the penalised loss.
    """
    out = {}
    for kind, soft in posterior.items():
        rows = [(seen, n) for k, seen, n in patterns if k == kind]
        seen, n = np.array([s for s, _ in rows]), np.array([c for _, c in rows], float)
        y = np.array([soft[tuple(s[: len(LABELERS)])] for s, _ in rows])
        x = np.concatenate([np.ones((len(n), 1)), *[seen[:, [k]] == np.arange(m) for k, m in enumerate(FEATURES.values())]], axis=1)
        w = np.zeros(x.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (n * (p * (1 - p) + 1e-6))[:, None]).T @ x + penalty * np.eye(len(w)), x.T @ (n * (y - p)) - penalty * w)
            w += step / max(1.0, np.abs(step).max() / 4)
            if np.abs(step).max() < 1e-8:
                break
        at = 1 + np.cumsum([0, *FEATURES.values()])
        out[kind] = float(w[0]), {name: w[at[k] : at[k + 1]].tolist() for k, name in enumerate(FEATURES)}
    return out


def fit(docs: DataFrame, *, text_col: str = "text") -> dict[str, tuple[float, dict[str, list[float]]]]:
    """The span classifier, from all candidates of all texts."""
    # an outer explode: the planner would else test each text's candidates for null and emptiness first, by finding them twice more
    found = with_candidates(docs.select(F.col(text_col).alias("text")), "text", "spans").select(F.explode_outer("spans").alias("c")).where("c is not null")
    counts = found.groupBy("c.kind", *[f"c.{n}" for n in FEATURES]).agg(F.count("*").alias("n")).collect()  # bounded by FEATURES
    patterns = sorted((r.kind, tuple(r[n] for n in FEATURES), r.n) for r in counts)
    votes: dict[tuple, int] = {}
    for kind, seen, n in patterns:
        key = kind, seen[: len(LABELERS)]
        votes[key] = votes.get(key, 0) + n
    return train(patterns, estimate([(kind, v, n) for (kind, v), n in votes.items()]))


def _accepted(weights: dict[str, tuple[float, dict[str, list[float]]]], c: Column) -> Column:
    score = F.lit(-1.0)
    for kind, (bias, of) in weights.items():
        terms = F.lit(bias)
        for name, values in of.items():
            terms = terms + F.get(F.array(*[F.lit(v) for v in values]), c[name])
        score = F.when(c["kind"] == kind, terms).otherwise(score)
    return c["base"] | (score > 0)


def with_spans(docs: DataFrame, weights: dict[str, tuple[float, dict[str, list[float]]]], *, text_col: str, out_col: str) -> DataFrame:
    """docs with the accepted spans in order of (s, rank, e): (s, rank, e, other, kind, base). Equal places of a kind are one span."""
    rows = with_candidates(docs, text_col, out_col)
    kept = F.filter(out_col, lambda c: _accepted(weights, c))
    kept = F.sort_array(F.transform(kept, lambda c: F.struct(c["s"].alias("s"), c["rank"].alias("rank"), c["e"].alias("e"), (~c["base"]).alias("other"), c["kind"].alias("kind"), c["base"].alias("base"))))
    place = lambda x: F.struct(x["s"], x["rank"], x["e"])
    return rows.withColumn(out_col, let(kept, lambda spans: F.filter(spans, lambda x, i: (i == 0) | (place(x) != place(F.get(spans, i - 1))))))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def _is(kind: str):
    return lambda x: x == kind


def find(docs: DataFrame, weights: dict[str, tuple[float, dict[str, list[float]]]], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all, written as kind:start:end), n_spans."""
    rows = with_spans(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), weights, text_col="text", out_col="found")
    base = F.filter("found", lambda x: x["base"])
    rows = rows.select("id", "found", base.alias("base"))
    return rows.select(
        F.col("id").alias(id_col),
        *[F.size(F.filter(F.transform("base", lambda x: x["kind"]), _is(kind))).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS],
        F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _written(F.col("found")).alias("spans"),
        F.size("found").cast("long").alias("n_spans"),
    )


def _piece_of(pieces: Column, a: Column, b: Column) -> Column:
    """The text from code point a to b, from its cut into pieces."""
    first = F.floor(a / PIECE).cast("int")
    some = F.slice(pieces, first + 1, F.floor((b - 1) / PIECE).cast("int") - first + 1)

    def part(p: Column, j: Column) -> Column:
        begin = F.greatest(a - (first + j) * PIECE, F.lit(0))
        return F.substr(p, begin + 1, F.least(b - (first + j) * PIECE, F.lit(PIECE)) - begin)

    return F.when(b > a, F.array_join(F.transform(some, part), "")).otherwise(F.lit(""))


def redact(docs: DataFrame, weights: dict[str, tuple[float, dict[str, list[float]]]], *, text_col: str = "text") -> DataFrame:
    """docs with every found span replaced by its kind in brackets; spans that overlap an earlier one go with it."""
    rows = with_spans(docs, weights, text_col=text_col, out_col="spans to redact")
    text, spans = F.col(text_col), F.col("`spans to redact`")

    def written(pieces: Column) -> Column:
        def after(ends: Column) -> Column:
            # at: where the text that is still to be written begins
            told = F.filter(F.transform(spans, lambda x, i: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), F.coalesce(F.get(ends, i - 1), F.lit(0)).alias("at"))), lambda x: x["s"] >= x["at"])
            kept = F.transform(told, lambda x: F.concat(_piece_of(pieces, x["at"], x["s"]), F.lit("["), F.upper(x["kind"]), F.lit("]")))
            return F.concat(F.array_join(kept, ""), _piece_of(pieces, F.element_at(ends, -1), F.length(text)))

        return let(running(F.transform(spans, lambda x: x["e"]), lambda a, b: F.greatest(a, b)), after)

    clean = let(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0)), written)
    return rows.withColumn(text_col, F.when(F.size(spans) > 0, clean).otherwise(text)).select(*docs.columns)
