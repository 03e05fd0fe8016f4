"""Personal data by candidate gradient boosting, in DataFrame operations only.

Base spans come from strict patterns. High-recall generators propose further, possibly overlapping
spans (masked addresses, numbers in groups); boosted trees score each from its format and its
context, and those whose calibrated probability passes a threshold are added. The trees are fitted
here, on examples that SQL expressions make (right and misleading formats and contexts), through the
same generators and features; they run as CASE expressions over the few candidates of a text.

A text is passed over once for each pattern: matches are fenced by a private-use character, the text
is split there and positions are running sums of the parts' lengths.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_names, let, positional

KINDS = ("email", "ip", "card", "phone")
FENCE, STAND_IN = "\ue000", "\ue001"
#: The strict patterns. Possessive, so that no long text makes the matcher recurse or
#: go back; a run is entered only at its start (or where the last match ended), so that none is
#: read from each of its characters.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: Generators.
AT, DOT = r"(?:@|\s?[\[(]\s?at\s?[\])]\s?)", r"(?:\.|\s?[\[(]\s?dot\s?[\])]\s?)"
MASKED_EMAIL = rf"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+{AT}[A-Za-z0-9-]{{1,63}}+(?:{DOT}[A-Za-z0-9-]{{1,63}}+){{1,5}}+"
MASKED_IP = r"(?<![0-9])[0-9]{1,4}(?:\s?[\[(]\.[\])]\s?[0-9]{1,4}){3}(?![0-9])"
GROUPED = r"(?<![A-Za-z0-9.,+])\(?[0-9]{1,4}+\)?(?:[ ./-]{1,2}\(?[0-9]{2,7}+\)?){1,6}+(?![A-Za-z0-9])"
#: Context that speaks for a kind, and against any.
HINTS = (
    r"(?i)\b(e-?mail|mail|contact|write|kontakt|correo)\b",
    r"(?i)\b(ip|host|server|address|addr|adresse)\b",
    r"(?i)\b(card|visa|credit|karte|carte|tarjeta)\b",
    r"(?i)\b(phone|tel|call|fax|mobile|telefon|tél|teléfono)\b",
)
AGAINST = r"(?i)\b(version|isbn|order|total|date|page|item|ref|article|no)\b"
CONTEXT = 24
#: Elements that a running reduction appends one by one, and code points of a text's blocks.
CHUNK, BLOCK = 256, 1024
#: A number over 255, whatever its length and leading zeros.
LARGE = r"(?<![0-9])0*+(?:[1-9][0-9]{3}|[3-9][0-9]{2}|2[6-9][0-9]|25[6-9])"
FEATURES = (
    "kind", "digits", "signs", "groups", "longest", "luhn", "small", "hint", "against", "masked", "opens", "label", "beside",
)
ROUNDS, DEPTH, RATE, CUTS = 40, 3, 0.3, 16
#: Examples made, half of them held out for the calibration, and the least calibrated probability.
EXAMPLES, THRESHOLD = 4000, 0.9


def running(values: Column, op) -> Column:
    """For each element of an array of int, op over all elements before it (0 before the first). An array
    grows by copying, so elements are appended within chunks, and then once for each chunk."""
    none = F.array().cast("array<int>")
    zero = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc, x):
        return F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def over(parts):
        ahead = F.aggregate(F.transform(parts, lambda p: p["at"]), zero, step)["out"]
        return F.flatten(F.zip_with(parts, ahead, lambda p, a: F.transform(p["out"], lambda x: op(a, x))))

    def of(v):
        firsts = F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), F.lit(CHUNK))
        return let(F.transform(firsts, lambda i: F.aggregate(F.slice(v, i, CHUNK), zero, step)), over)

    return let(values, of)


def blocks(text: Column) -> Column:
    """A text in pieces of BLOCK code points: a short piece is then cut out without a walk from the start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def cut_out(pieces: Column, start: Column, n: Column) -> Column:
    """n code points from `start` of a text in blocks, or as many as there are."""
    first, last = (F.floor(x / BLOCK).cast("int") for x in (start, start + n - 1))
    joined = F.array_join(F.slice(pieces, first + 1, last - first + 1), "")
    return F.when(n > 0, F.substring(joined, start - first * BLOCK + 1, n)).otherwise(F.lit(""))


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, s>> of a pattern's matches, leftmost first, in code points."""
    safe = F.replace(text, F.lit(FENCE), F.lit(STAND_IN))

    def of(parts):
        starts = running(F.transform(parts, lambda p: F.length(p)), lambda x, y: x + y)
        spans = F.zip_with(parts, starts, lambda p, a: F.struct(a.alias("start"), (a + F.length(p)).alias("end"), p.alias("s")))
        return F.filter(spans, lambda x, i: i % 2 == 1)  # between an odd fence and the next lies a match

    return let(F.split(F.regexp_replace(safe, pattern, FENCE + "$0" + FENCE), FENCE, -1), of)


def _if(test: Column, spans: Column) -> Column:
    empty = F.array().cast("array<struct<start:int,end:int,s:string>>")
    return F.when(test, spans).otherwise(empty)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """The weighted sum of a string of digits, the last one weighing one."""
    n = F.length(digits)
    each = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1),
    )
    return F.aggregate(each, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d))


def _small_parts(s: Column) -> Column:
    """Whether all runs of digits, of any length, are at most 255 (leading zeros do not count)."""
    return ~s.rlike(LARGE)


def base_spans(text: Column) -> Column:
    """array<struct<start, end, kind, s>> of the strict patterns' valid matches, by start and kind."""
    some = text.rlike("[0-9]")
    n = lambda s: F.length(_digits(s))
    found = (
        _if(text.contains("@"), _matches(text, EMAIL)),
        F.filter(_if(text.rlike(r"[0-9]\.[0-9]"), _matches(text, IP)), lambda m: _small_parts(m["s"])),
        F.filter(_if(some, _matches(text, CARD)), lambda m: n(m["s"]).between(12, 19) & (luhn_sum(_digits(m["s"])) % 10 == 0)),
        F.filter(_if(text.contains("+"), _matches(text, PHONE)), lambda m: n(m["s"]).between(9, 15)),
    )
    return _ordered(found)


def _ordered(found) -> Column:
    def of(k: int):  # a lambda's second argument would be the index
        return lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end"), m["s"].alias("s"))

    return F.array_sort(F.concat(*[F.transform(f, of(k)) for k, f in enumerate(found)]))


def _is(kind: int):
    return lambda s: s["kind"] == kind


def proposals(text: Column) -> Column:
    """array<struct<start, kind, end, s>> of the generators' spans; they may overlap."""
    grouped = _if(text.rlike(r"[0-9]\)?[ ./-]{1,2}\(?[0-9]"), _matches(text, GROUPED))
    n = lambda s: F.length(_digits(s))
    return _ordered(
        (
            _if(text.rlike(r"(?i)@|[\[(]\s?at\s?[\])]"), _matches(text, MASKED_EMAIL)),
            _if(text.rlike(r"[0-9]\s?[\[(]\.[\])]"), _matches(text, MASKED_IP)),
            F.filter(grouped, lambda m: n(m["s"]).between(12, 19)),
            F.filter(grouped, lambda m: n(m["s"]).between(7, 15)),
        )
    )


def apart(base: Column, near: Column) -> Column:
    """The spans of `near` that overlap none of `base`, in one pass over both: a proposal meets the furthest
    end of the base spans that start before it ends."""
    none = F.lit(None).cast("struct<start:int,kind:int,end:int,s:string>")
    events = F.concat(
        F.transform(base, lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("side"), b["end"].alias("reach"), none.alias("c"))),
        F.transform(near, lambda c: F.struct(c["end"].alias("at"), F.lit(0).alias("side"), F.lit(0).alias("reach"), c.alias("c"))),
    )

    def of(e):
        reach = running(F.transform(e, lambda x: x["reach"]), lambda x, y: F.greatest(x, y))
        met = F.zip_with(e, reach, lambda x, r: F.struct(x["c"].alias("c"), ((x["side"] == 0) & (r <= x["c"]["start"])).alias("free")))
        return F.transform(F.filter(met, lambda x: x["free"]), lambda x: x["c"])

    return let(F.array_sort(events), of)


def span_features(pieces: Column, c: Column) -> Column:
    """A struct of doubles, named as FEATURES, for a proposed span c of a text in blocks."""
    s, kind = c["s"], c["kind"]
    left = cut_out(pieces, F.greatest(c["start"] - CONTEXT, F.lit(0)), F.least(c["start"], F.lit(CONTEXT)))
    right = cut_out(pieces, c["end"], F.lit(2))
    hint = F.lit(False)
    for k, pattern in enumerate(HINTS):
        hint = hint | ((kind == k) & left.rlike(pattern))
    digits = _digits(s)
    runs = F.regexp_extract_all(s, F.lit("([0-9]+)"), F.lit(1))
    values = {
        "kind": kind,
        "digits": F.length(digits),
        "signs": F.length(F.regexp_replace(s, r"[A-Za-z0-9]", "")),
        "groups": F.size(runs),
        "longest": F.aggregate(runs, F.lit(0), lambda m, r: F.greatest(m, F.length(r))),
        "luhn": F.when(F.length(digits).between(12, 19), luhn_sum(digits) % 10 == 0).otherwise(F.lit(False)),
        "small": _small_parts(s),
        "hint": hint,
        "against": left.rlike(AGAINST),
        "masked": s.rlike(r"(?i)[\[(]\s?(at|dot|\.)\s?[\])]"),
        "opens": s.rlike(r"^[(0]"),
        "label": s.rlike(r"[.)\]]\s?[A-Za-z]{2,24}$"),
        "beside": right.rlike(r"^\s?[%$€£:=]") | left.rlike(r"[$€£=#]\s?$"),
    }
    return F.struct(*[values[f].cast("double").alias(f) for f in FEATURES])


# --- the boosted trees -------------------------------------------------------------------------


def examples(spark: SparkSession, n: int = EXAMPLES) -> DataFrame:
    """id, kind, y, text: made examples of right (y 1) and misleading (y 0) spans in context."""
    def pick(salt: int, *options: str) -> Column:
        at = F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(options))).cast("int")
        return F.element_at(F.array(*map(F.lit, options)), at + 1)

    def digits(salt: int, k: int) -> Column:
        return F.lpad(F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(10**k)).cast("string"), k, "0")

    def byte(salt: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(256)).cast("string")

    c = F.concat
    at, dot, cut = pick(1, "@", " (at) ", "[at]", " [ at ] "), pick(2, ".", " [dot] ", "(dot)"), pick(3, "-", " ", ".")
    name, host = pick(4, "ann", "j.doe", "info", "li_wei"), pick(5, "mail", "example", "web-1")
    mark = pick(6, "[.]", "(.)", " [.] ")
    front = digits(7, 15)
    check = F.pmod(F.lit(10) - F.pmod(luhn_sum(c(front, F.lit("0"))), F.lit(10)), F.lit(10))
    valid = c(front, check.cast("string"))
    broken = c(front, F.pmod(check + 1 + F.pmod(F.xxhash64("id", F.lit(8)), F.lit(9)), F.lit(10)).cast("string"))
    fours = lambda s, sep: c(F.substring(s, 1, 4), sep, F.substring(s, 5, 4), sep, F.substring(s, 9, 4), sep, F.substring(s, 13, 4))
    slash = pick(9, ".", "/", " - ")
    hint = [
        pick(10, "mail ", "contact: ", "write to ", "the ", ""),
        pick(11, "ip ", "host ", "server at ", "the ", ""),
        pick(12, "card ", "visa ", "credit card no ", "by ", ""),
        pick(13, "call ", "tel. ", "phone: ", "fax ", "mobile "),
    ]
    decoy = pick(14, "version ", "isbn ", "order ", "total ", "date ", "page ", "the ", "item no ", "of ", "")
    phone = F.element_at(
        F.array(
            c(F.lit("("), digits(15, 3), F.lit(") 555"), cut, digits(16, 4)),
            c(digits(15, 3), cut, digits(16, 3), cut, digits(17, 4)),
            c(F.lit("0"), digits(15, 2), F.lit(" "), digits(16, 7)),
            c(F.lit("0049 "), digits(15, 2), F.lit(" "), digits(16, 6)),
        ),
        (F.pmod(F.xxhash64("id", F.lit(18)), F.lit(4)) + 1).cast("int"),
    )
    number = F.element_at(
        F.array(
            c(F.lit("20"), digits(15, 2), F.lit("-"), digits(16, 2), F.lit("-"), digits(17, 2)),
            c(digits(15, 2), F.lit("/"), digits(16, 2), F.lit("/20"), digits(17, 2)),
            c(digits(15, 1), F.lit(" "), digits(16, 3), F.lit(" "), digits(17, 3)),
            c(F.lit("978-"), digits(15, 1), F.lit("-"), digits(16, 4), F.lit("-"), digits(17, 4)),
            c(digits(15, 4), F.lit(" "), digits(16, 4), F.lit(" "), digits(17, 4)),
            c(digits(15, 3), F.lit(" "), digits(16, 5), F.lit(" "), digits(17, 2), F.lit("%")),
        ),
        (F.pmod(F.xxhash64("id", F.lit(18)), F.lit(6)) + 1).cast("int"),
    )
    right = [
        c(hint[0], name, at, host, dot, pick(19, "com", "org", "de")),
        c(hint[1], byte(20), mark, byte(21), mark, byte(22), mark, byte(23)),
        c(hint[2], fours(valid, slash)),
        c(hint[3], phone),
    ]
    wrong = [
        c(decoy, pick(24, "list", "f", "tab2"), pick(25, "(at)", "@", "[at]"), digits(26, 1), pick(27, ".", "(dot)"), digits(28, 2)),
        c(decoy, digits(29, 1), mark, digits(30, 3), mark, F.lit("4"), digits(31, 2), mark, digits(32, 4)),
        c(decoy, fours(broken, slash)),
        c(decoy, number),
    ]
    kind = (F.col("id") % 4).cast("int")
    y = (F.floor(F.col("id") / 4) % 2).cast("int")
    text = F.element_at(F.array(*wrong, *right), y * 4 + kind + 1)
    rows = spark.range(n).select("id", kind.alias("kind"), y.alias("y"), c(F.lit("so "), text, pick(33, " there", ".", ", and", "")).alias("text"))
    return rows


@dataclass
class Trees:
    """Boosted regression trees on log odds. A tree is (feature, cut, tree, tree) or a number."""

    start: float
    trees: list
    slope: float = 1.0  # calibration of the margin
    shift: float = 0.0
    cut: float = 0.0  # least margin that is accepted

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)

        def add(tree, rows):
            if isinstance(tree, tuple):
                left = x[rows, tree[0]] <= tree[1]
                add(tree[2], rows[left])
                add(tree[3], rows[~left])
            else:
                out[rows] += tree

        for tree in self.trees:
            add(tree, np.arange(len(x)))
        return out

    def column(self, f: Column) -> Column:
        """The margin as an expression over a struct of FEATURES."""

        def of(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            return F.when(f[FEATURES[tree[0]]] <= float(tree[1]), of(tree[2])).otherwise(of(tree[3]))

        total = F.lit(float(self.start))
        for tree in self.trees:
            total = total + of(tree)
        return total


def _grow(x, g, h, rows, depth):
    """Newton tree on gradients g and curvatures h, with the best cut of each node among quantiles."""
    G, H = g[rows].sum(), h[rows].sum()
    leaf = RATE * G / (H + 1.0)
    if depth == 0 or len(rows) < 20:
        return leaf
    best = (1e-6, None, None)
    for f in range(x.shape[1]):
        v = x[rows, f]
        for cut in np.unique(np.quantile(v, np.linspace(0, 1, CUTS), method="lower"))[:-1]:
            left = v <= cut
            a, b = g[rows[left]].sum(), h[rows[left]].sum()
            gain = a * a / (b + 1) + (G - a) ** 2 / (H - b + 1) - G * G / (H + 1)
            if gain > best[0]:
                best = (gain, f, float(cut))
    if best[1] is None:
        return leaf
    left = x[rows, best[1]] <= best[2]
    return (best[1], best[2], _grow(x, g, h, rows[left], depth - 1), _grow(x, g, h, rows[~left], depth - 1))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> Trees:
    rate = (y.sum() + 1) / (len(y) + 2)
    model = Trees(float(np.log(rate / (1 - rate))), [])
    margin = np.full(len(y), model.start)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        tree = _grow(x, y - p, p * (1 - p), np.arange(len(y)), DEPTH)
        model.trees.append(tree)
        margin += Trees(0.0, [tree]).margin(x)
    return model


def calibrate(model: Trees, x: np.ndarray, y: np.ndarray, threshold: float = THRESHOLD) -> Trees:
    """Fit P(y) = sigmoid(slope margin + shift) on held-out examples and set the least margin."""
    m, w = model.margin(x), np.zeros(2)
    w[0] = 1
    z = np.stack([m, np.ones(len(m))], axis=1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2), z.T @ (y - p) - 1e-3 * w)
        w += np.clip(step, -1, 1)
    model.slope, model.shift = float(max(w[0], 1e-3)), float(w[1])
    model.cut = (float(np.log(threshold / (1 - threshold))) - model.shift) / model.slope
    return model


def example_features(spark: SparkSession, n: int = EXAMPLES):
    """(features, y, id) of the made examples' candidates of their own kind; n bounds the rows read."""
    rows = examples(spark, n).withColumn("c", F.explode(F.filter(proposals(F.col("text")), lambda c: c["kind"] == F.col("kind"))))
    rows = rows.select("id", "y", span_features(blocks(F.col("text")), F.col("c")).alias("f")).orderBy("id").collect()
    x = np.array([list(r["f"]) for r in rows], float).reshape(-1, len(FEATURES))
    return x, np.array([r["y"] for r in rows], float), np.array([r["id"] for r in rows])


_MODELS: dict[tuple, Trees] = {}


def fitted(spark: SparkSession, n: int = EXAMPLES, threshold: float = THRESHOLD) -> Trees:
    """The model, fitted once a process."""
    if (n, threshold) not in _MODELS:
        x, y, ids = example_features(spark, n)
        half = (ids // 8) % 2 == 0
        _MODELS[n, threshold] = calibrate(boost(x[half], y[half]), x[~half], y[~half], threshold)
    return _MODELS[n, threshold]


# --- operators ---------------------------------------------------------------------------------


def _spanned(docs: DataFrame, text_col: str, threshold: float = THRESHOLD) -> tuple[DataFrame, str]:
    """docs by place with base and spans, and the text's column."""
    model = fitted(docs.sparkSession, threshold=threshold)
    plain, t = positional(docs, text_col)
    out = plain.withColumn("pii", F.coalesce(plain[t].cast("string"), F.lit("")))
    out = out.withColumns({"base": base_spans(F.col("pii")), "near": proposals(F.col("pii"))})
    out = out.withColumn("near", F.when(F.size("near") > 0, apart(F.col("base"), F.col("near"))))
    scored = let(
        blocks(F.col("pii")),
        lambda p: F.transform("near", lambda c: F.struct(c.alias("c"), span_features(p, c).alias("f"))),
    )
    out = out.withColumn("near", F.when(F.size("near") > 0, scored))
    passed = F.transform(F.filter("near", lambda x: model.column(x["f"]) >= model.cut), lambda x: x["c"])
    out = out.withColumn("spans", F.array_sort(F.concat("base", F.coalesce(passed, F.slice("base", 1, 0)))))
    return out.drop("pii", "near"), t


def with_spans(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with base and spans, arrays of struct<start, kind, end, s>: the strict patterns' spans, and
    those with the accepted proposals (which overlap no base span), both by start and kind.

    Positions are code points, ends exclusive; kind is an index of KINDS. Null and empty texts have
    empty arrays. Rows are kept as they are, in number and in their other columns; where docs has a
    column base or spans, the added one has an underscore after its name. The work is linear in the text
    and its matches, but for sorting. Empty tables give empty results.
    """
    return _spanned(docs, text_col, threshold)[0].toDF(*docs.columns, *free_names(docs.columns, "base", "spans"))


def printed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256 and
    spans (all). Repeated rows and null ids stay; an empty table gives an empty result."""
    plain, i, t = positional(docs, id_col, text_col)
    rows = with_spans(plain.select(plain[i].alias("doc_id"), plain[t].alias("text"))).select("doc_id", "base", "spans")
    counts = {
        f"n_{name}": F.size(F.filter("base", _is(k))).cast("long") for k, name in enumerate(KINDS)
    }
    return rows.select(
        "doc_id",
        *[c.alias(n) for n, c in counts.items()],
        F.sha2(printed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        printed(F.col("spans")).alias("spans"),
    )


def redacted(text: Column, spans: Column) -> Column:
    """text with every maximal union of overlapping spans (by start) replaced by [KIND] of its first span."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def of(s):
        reach = running(F.transform(s, lambda x: x["end"]), lambda x, y: F.greatest(x, y))
        met = F.zip_with(s, reach, lambda x, r: F.struct(r.alias("lo"), x["start"].alias("hi"), x["kind"].alias("kind")))
        heads = F.filter(met, lambda h: h["hi"] >= h["lo"])  # what no span before reaches into

        def write(p):
            out = F.transform(heads, lambda h: F.concat(cut_out(p, h["lo"], h["hi"] - h["lo"]), F.element_at(names, h["kind"] + 1)))
            end = F.array_max(F.transform(s, lambda x: x["end"]))
            return F.concat(F.array_join(out, ""), cut_out(p, end, F.length(text) - end))

        return let(blocks(text), write)

    return F.when(F.size(spans) > 0, let(spans, of)).otherwise(text)


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """docs with the personal data of its texts replaced; length_col, if any, is brought in line. Null
    texts stay null; rows and other columns, whatever they are called, stay as they are."""
    out, t = _spanned(docs, text_col)
    out = out.withColumn(t, redacted(F.col(t), F.col("spans")))
    if length_col:
        n = docs.columns.index(length_col)
        out = out.withColumn(f"c{n}", F.length(t).cast(docs.schema[n].dataType))
    return out.drop("base", "spans").toDF(*docs.columns)
