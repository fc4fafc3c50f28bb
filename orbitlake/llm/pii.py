"""Personal data by candidate generation and boosted trees, in DataFrame functions alone.

Strict generators give the base spans (email, ip, card, phone: format, range, Luhn and
digit counts). Looser generators propose more, which may overlap: groups of seven or more
digits (`number`), runs of 12 or more characters with a digit or 20 without (`secret`), country
codes with account digits (`iban`), and 16-digit groups that pass Luhn in a longer run of
digits (`card`). Gradient-boosted trees score each proposal by its format, the marks around
it and the words since the last proposal; they are fitted on a synthetic table
(`training_rows`, TRAIN_ROWS rows: no row of the corpus) in which context words stand
before negatives too and positives also without them, and become a SQL expression, so scoring runs inside the
scan's stage without a shuffle. The threshold of each kind is the lowest score above which the
half of that table that fitting did not see has a precision of PRECISION. Of kept proposals
that overlap, the highest score stays, then the first; those that overlap a base span go. Base spans always stay.

Positions are code points, ends exclusive. Null texts count as empty: no spans. Columns
of the input whose names begin with pii_ are dropped by `find`. Patterns that can run long are possessive, and arrays grow
in chunks, so time is about linear in the text, however many matches it has.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The base patterns, greedy runs written possessively (same matches).
LOCAL, LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# Whole runs of 13 digits or more: a shorter run fails the count anyway, and there can be very many of those.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
NUMBER = r"(?<![0-9A-Za-z])\(?[0-9](?:[\x20().-]{0,2}+[0-9]){6,}+"
GROUPED = r"(?<![0-9])(?:[0-9]{16}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4})(?![0-9])"
SECRET = r"(?<![A-Za-z0-9+/_-])(?:(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{12,}+|[A-Za-z0-9+/_-]{20,}+)"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?+[A-Z0-9]){11,30}+(?![A-Za-z0-9])"
KINDS = ("email", "ip", "card", "phone", "number", "secret", "iban")
CONTEXT = r"(?i)(?:token|secret|passw|key|tel|phone|call|fax|mobile|card|account|iban|ssn)[^\n]{0,12}$"
ASSIGNED = r"""[="'] ?$"""
TRAIN_ROWS, PRECISION = 6000, 0.98
FEATURES = ("length", "digits", "letters", "upper", "marks", "variety", "context", "hex", "assigned", "colon", "joined", "bracket", "secret", "iban", "card")
#: Elements of one step of a fold, and characters of one piece of a long text.
FOLD, PIECE = 256, 4096


def _q(pattern: str) -> str:
    """As a SQL string literal."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _fold(items: str, state: str, kind: str, step: str, finish: str = "flatten(o.out)") -> str:
    """SQL: aggregate() over an array with `step` of (acc, x), acc holding st and a short out; outs of FOLD elements are joined once, so that long arrays take linear time."""
    return f"""transform(array({items}), a -> aggregate(IF(size(a) > 0, sequence(0, (size(a) - 1) div {FOLD}), cast(array() AS array<int>)),
        struct({state} AS st, cast(array() AS array<array<{kind}>>) AS out),
        (o, c) -> transform(array(aggregate(slice(a, c * {FOLD} + 1, {FOLD}), struct(o.st AS st, cast(array() AS array<{kind}>) AS out), (acc, x) -> {step})), r -> struct(r.st AS st, concat(o.out, array(r.out)) AS out))[0],
        o -> {finish}))[0]"""


_MATCH = "struct<s:int,e:int,m:string,b:string,a:string>"


def _places(text: str, pattern: str) -> str:
    """SQL: array of (s, e, m, b, a) of the leftmost non-overlapping matches; b and a: up to 31 characters since the last match, and the next one."""
    zipped = f"""transform(array(split({text}, {_q(pattern)}, -1)), g -> zip_with(zip_with(g, regexp_extract_all({text}, {_q(pattern)}, 0), (g, m) -> struct(g AS g, m AS m)),
        slice(g, 2, size(g)), (x, n) -> struct(x.g AS g, x.m AS m, left(n, 1) AS a)))[0]"""
    step = "IF(x.m IS NULL, acc, struct(acc.st + length(x.g) + length(x.m) AS st, concat(acc.out, array(struct(acc.st + length(x.g) AS s, acc.st + length(x.g) + length(x.m) AS e, x.m AS m, right(x.g, 31) AS b, coalesce(x.a, '') AS a))) AS out))"
    return f"CASE WHEN {text} RLIKE {_q(pattern)} THEN {_fold(zipped, '0', _MATCH, step)} ELSE cast(array() AS array<{_MATCH}>) END"


def _emails(text: str) -> str:
    """SQL: the same (s, e, m) for email, by the @ signs, so that long runs without one cost nothing. A domain's part that an earlier match took is not reused."""
    domain = f"^{LABEL}++(?:\\.{LABEL}++)++"
    step = f"""IF(acc.st.at < 0, struct(struct(length(x) AS at, x AS last, 0 AS used) AS st, acc.out AS out),
          transform(array(struct(
              reverse(regexp_extract(reverse(substring(acc.st.last, acc.st.used + 1)), '^{LOCAL}++', 0)) AS l,
              regexp_extract(x, {_q(domain)}, 0) AS d)),
            z -> IF(z.l <> '' AND z.d <> '',
              struct(struct(acc.st.at + 1 + length(x) AS at, x AS last, length(z.d) AS used) AS st, concat(acc.out, array(struct(acc.st.at - length(z.l) AS s, acc.st.at + 1 + length(z.d) AS e, concat(z.l, '@', z.d) AS m))) AS out),
              struct(struct(acc.st.at + 1 + length(x) AS at, x AS last, 0 AS used) AS st, acc.out AS out)))[0])"""
    kind = "struct<s:int,e:int,m:string>"
    folded = _fold(f"split({text}, '@', -1)", "struct(-1 AS at, '' AS last, 0 AS used)", kind, step)
    return f"CASE WHEN instr({text}, '@') > 0 THEN {folded} ELSE cast(array() AS array<{kind}>) END"


_LUHN = """aggregate(sequence(1, length(x.d)), 0, (t, i) -> t + IF(i % 2 = 0,
    IF(cast(substring(x.d, length(x.d) - i + 1, 1) AS int) > 4, cast(substring(x.d, length(x.d) - i + 1, 1) AS int) * 2 - 9, cast(substring(x.d, length(x.d) - i + 1, 1) AS int) * 2),
    cast(substring(x.d, length(x.d) - i + 1, 1) AS int))) % 10 = 0"""
_PART = "CASE WHEN length(ltrim('0', p)) > 3 THEN false ELSE cast(concat('0', ltrim('0', p)) AS int) <= 255 END"


def _kept(spans: str, kind: str, test: str) -> str:
    return f"transform(filter(transform({spans}, y -> struct(y.s AS s, y.e AS e, y.m AS m, regexp_replace(y.m, '[^0-9]', '') AS d)), x -> {test}), x -> struct('{kind}' AS kind, x.s AS s, x.e AS e))"


def _described(m: str, before: str, after: str, kind: str) -> str:
    """SQL: the features of one proposal."""
    return f"""struct(
        cast(length({m}) AS double) AS length,
        cast(length(regexp_replace({m}, '[^0-9]', '')) AS double) AS digits,
        cast(length(regexp_replace({m}, '[^A-Za-z]', '')) AS double) AS letters,
        cast(length(regexp_replace({m}, '[^A-Z]', '')) AS double) AS upper,
        cast(length(regexp_replace({m}, '[A-Za-z0-9]', '')) AS double) AS marks,
        cast(size(array_distinct(split(lower({m}), ''))) AS double) AS variety,
        IF({before} RLIKE {_q(CONTEXT)}, 1D, 0D) AS context,
        IF({m} RLIKE '^[0-9A-Fa-f]+$', 1D, 0D) AS hex,
        IF({before} RLIKE {_q(ASSIGNED)}, 1D, 0D) AS assigned,
        IF({before} RLIKE ': ?$', 1D, 0D) AS colon,
        IF({before} RLIKE '[0-9][.,-]?$' OR {after} RLIKE '^[0-9]', 1D, 0D) AS joined,
        IF({m} LIKE '(%', 1D, 0D) AS bracket,
        IF({kind} = 'secret', 1D, 0D) AS secret,
        IF({kind} = 'iban', 1D, 0D) AS iban,
        IF({kind} = 'card', 1D, 0D) AS card)"""


def training_rows(spark: SparkSession, rows: int = TRAIN_ROWS, seed: int = 1) -> DataFrame:
    """A labelled synthetic table of proposals with what stands before and after: columns kind, m, before, after, label.

    Twelve shapes in turn, each with context words before some of its rows. Positive: assigned hex tokens, mixed keys, phone
    numbers in brackets, grouped account numbers, grouped cards, country codes with account digits. Negative:
    long words with a digit, digests in prose, dates and ranges, plain and grouped digits, paths, cards inside longer numbers.
    """
    h = lambda k: f"sha2(concat(id, ':{seed}:{k}'), 256)"
    u = lambda k, n: f"cast(pmod(xxhash64(id, {seed}, {k}), {n}) AS int)"
    digits = lambda k: f"translate({h(k)}, 'abcdef', '012345')"
    word = lambda k: f"translate(substring({h(k)}, 1, 24), '0123456789', 'ghijklmnop')"
    # Words that introduce a secret or a number, and others.
    told = f"element_at(array('token', 'secret', 'password', 'api_key', 'Key', 'phone', 'tel', 'call', 'Fax', 'mobile', 'account', 'card', 'IBAN'), 1 + {u(20, 13)})"
    other = f"element_at(array('commit', 'sum', 'value', 'see', 'on', 'id', 'from', 'page', 'file', 'about'), 1 + {u(21, 10)})"
    mark = f"element_at(array('=', ' = \"', ': ', ':', '=\\''), 1 + {u(22, 5)})"
    space = f"IF(id % 12 IN (3, 8, 9) AND {u(23, 3)} = 0, ': ', ' ')"
    # of 10 rows of each shape: how many have a context word, and how many a mark before them
    context, marked = (6, 5, 5, 10, 4, 5, 3, 1, 3, 1, 2, 1), (10, 4, 2, 3, 2, 3, 1, 0, 2, 1, 2, 0)
    pick = lambda v: "element_at(array(" + ", ".join(map(str, v)) + "), 1 + cast(id % 12 AS int))"
    group = f"concat(substring({digits(6)}, 1, 4), ' ', substring({digits(6)}, 5, 4), ' ', substring({digits(6)}, 9, 4), ' ', substring({digits(6)}, 13, 4))"
    # Luhn's sum of 15 digits that a check digit follows
    check = "aggregate(sequence(1, 15), 0, (t, i) -> t + IF(i % 2 = 1, cast(substring('0246813579', 1 + cast(substring(d, i, 1) AS int), 1) AS int), cast(substring(d, i, 1) AS int)))"
    return spark.range(rows).selectExpr(
        "id",
        "cast(id % 12 AS int) AS shape",
        "element_at(array('secret', 'secret', 'number', 'number', 'card', 'iban', 'secret', 'secret', 'number', 'number', 'secret', 'card'), 1 + cast(id % 12 AS int)) AS kind",
        f"""CASE id % 12
            WHEN 0 THEN substring({h(1)}, 1, 12 + {u(1, 52)})
            WHEN 1 THEN concat(upper(substring({h(2)}, 1, 4 + {u(2, 8)})), substring({word(3)}, 1, 4 + {u(3, 10)}), substring({digits(4)}, 1, 4 + {u(4, 6)}), upper(substring({word(5)}, 1, {u(5, 8)})))
            WHEN 2 THEN concat('(', substring({digits(5)}, 1, 3), ') ', substring({digits(5)}, 4, 3), '-', substring({digits(5)}, 7, 4))
            WHEN 3 THEN concat(substring({digits(6)}, 1, 4), ' ', substring({digits(6)}, 5, 4), ' ', substring({digits(6)}, 9, 2 + {u(6, 6)}))
            WHEN 4 THEN transform(array(substring(replace({group}, ' ', ''), 1, 15)), d -> transform(array(concat(d, cast(pmod(10 - {check}, 10) AS string))), x ->
                concat(substring(x, 1, 4), '-', substring(x, 5, 4), '-', substring(x, 9, 4), '-', substring(x, 13, 4)))[0])[0]
            WHEN 5 THEN concat(upper(substring({word(7)}, 1, 2)), substring({digits(7)}, 1, 2), substring({digits(8)}, 1, 14 + {u(7, 10)}))
            WHEN 6 THEN concat({word(7)}, IF({u(8, 2)} = 0, '-', ''), substring({word(8)}, 1, {u(9, 9)}), IF({u(25, 2)} = 0, '', cast(id % 10 AS string)))
            WHEN 7 THEN substring({h(10)}, 1, 12 + {u(10, 52)})
            WHEN 8 THEN concat(substring({digits(9)}, 1, 4), '-', substring({digits(9)}, 5, 2 + {u(11, 3)}), IF({u(12, 2)} = 0, concat('-', substring({digits(9)}, 7, 2)), ''))
            WHEN 9 THEN CASE {u(24, 3)} WHEN 0 THEN substring({digits(8)}, 1, 7 + {u(13, 13)}) WHEN 1 THEN replace({group}, ' ', '-') ELSE concat({group}, ' ', substring({digits(8)}, 1, {u(13, 30)})) END
            WHEN 10 THEN concat(substring({word(14)}, 1, 3 + {u(14, 5)}), '/', substring({word(15)}, 1, 4 + {u(15, 9)}), '/', substring({word(16)}, 1, 6), IF({u(16, 2)} = 0, '3', ''), '/', substring({word(17)}, 1, 8))
            ELSE {group} END AS m""",
        f"concat({word(11)}, ' ', IF({u(17, 10)} < {pick(context)}, {told}, {other}), IF({u(18, 10)} < {pick(marked)}, {mark}, {space}), IF(id % 12 = 11, substring({digits(12)}, 1, 3), '')) AS before",
        f"IF(id % 12 = 11, substring({digits(13)}, 1, 1), IF({u(19, 3)} = 0, '\"', ' ')) AS after",
        "IF(id % 12 < 6, 1D, 0D) AS label",
    )


def _tree_sql(debug: str, names: tuple[str, ...]) -> list[str]:
    """Each tree of a model's text form as nested CASE expressions over f.<name>."""
    trees = []
    for block in re.split(r"Tree \d+ \(weight [0-9.]+\):\n", debug)[1:]:
        lines = [x.strip() for x in block.strip().splitlines()]

        def read() -> str:
            line = lines.pop(0)
            if m := re.match(r"Predict: (\S+)", line):
                return f"{float(m[1])!r}D"
            m = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
            yes = read()
            lines.pop(0)
            return f"IF(f.{names[int(m[1])]} <= {float(m[2])!r}D, {yes}, {read()})"

        trees.append(read())
    return trees


@lru_cache(maxsize=4)
def _fitted(app: str, rows: int) -> tuple[str, dict[str, float]]:
    spark = SparkSession.active()
    table = training_rows(spark, rows).selectExpr("id", "kind", "label", f"{_described('m', 'before', 'after', 'kind')} AS f").select("id", "kind", "label", "f", "f.*")
    table = table.repartition(2, "id")
    model = GBTClassifier(featuresCol="x", labelCol="label", maxIter=12, maxDepth=4, seed=7).fit(VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(table.where("cast(id / 12 AS int) % 2 = 0")))
    total = " + ".join(f"{w!r}D * ({t})" for w, t in zip(model.treeWeights, _tree_sql(model.toDebugString, FEATURES), strict=True))
    score = f"(1D / (1D + exp(-2D * ({total}))))"
    held = table.where("cast(id / 12 AS int) % 2 = 1").selectExpr("kind", "label", f"{score} AS p").groupBy("kind", "p").agg(F.sum("label").alias("good"), F.count("*").alias("n"))
    above = Window.partitionBy("kind").orderBy(F.desc("p"))
    good = held.select("kind", "p", (F.sum("good").over(above) / F.sum("n").over(above)).alias("precision")).where(F.col("precision") >= PRECISION)
    return score, {r["kind"]: r["p"] for r in good.groupBy("kind").agg(F.min("p").alias("p")).collect()}


def fitted(spark: SparkSession, rows: int = TRAIN_ROWS) -> tuple[str, dict[str, float]]:
    """The trees as one SQL expression over a struct f, and the calibrated threshold of each kind; a kind without one keeps nothing."""
    return _fitted(spark.sparkContext.applicationId, rows)


def find(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with `pii_base` and `pii_added`: arrays of (kind, s, e), each by kind as listed, then start."""
    score, least = fitted(docs.sparkSession)
    docs = docs.drop(*[c for c in docs.columns if c.startswith("pii_")])  # names of this module's own
    t = "pii_text"
    df = docs.withColumn(t, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    patterns = {"i": IP, "c": CARD, "p": PHONE, "n": NUMBER, "s": SECRET, "g": GROUPED, "b": IBAN}
    df = df.selectExpr("*", f"{_emails(t)} AS pii_e", *[f"{_places(t, p)} AS pii_{k}" for k, p in patterns.items()])
    base = ", ".join(
        (
            _kept("pii_e", "email", "true"),
            _kept("pii_i", "ip", f"forall(split(x.m, '[.]'), p -> {_PART})"),
            _kept("pii_c", "card", f"length(x.d) BETWEEN 13 AND 19 AND {_LUHN}"),
            _kept("pii_p", "phone", "length(x.d) BETWEEN 9 AND 15"),
        )
    )
    card = f"filter(pii_g, y -> exists(transform(array(regexp_replace(y.m, '[^0-9]', '')), d -> struct(d AS d)), x -> {_LUHN}))"
    proposed = ", ".join(f"transform({a}, y -> struct('{k}' AS kind, y.s AS s, y.e AS e, {_described('y.m', 'y.b', 'y.a', repr(k))} AS f))" for k, a in (("number", "pii_n"), ("secret", "pii_s"), ("iban", "pii_b"), ("card", card)))
    bound = "CASE x.kind " + " ".join(f"WHEN '{k}' THEN {v!r}D" for k, v in sorted(least.items())) + " ELSE 2D END"
    df = df.selectExpr(*docs.columns, f"concat({base}) AS pii_base", f"concat({proposed}) AS pii_seen")
    scored = f"filter(transform(pii_seen, y -> transform(array(y.f), f -> struct(y.s AS s, y.e AS e, {score} AS p, y.kind AS kind))[0]), x -> x.p >= {bound})"
    df = df.selectExpr(*docs.columns, "pii_base", f"IF(size(pii_seen) = 0, cast(array() AS array<struct<s:int,e:int,p:double,kind:string>>), {scored}) AS pii_held")
    # by start; base spans have a score above all
    both = "array_sort(concat(transform(pii_base, x -> struct(x.s AS s, x.e AS e, 2D AS p, x.kind AS kind)), pii_held))"
    kind, now = "struct<kind:string,s:int,e:int>", "struct(acc.st.kind AS kind, acc.st.s AS s, acc.st.e AS e)"
    own = "IF(acc.st.p BETWEEN 0 AND 1, array({now}), cast(array() AS array<{kind}>))".format(now=now, kind=kind)
    grown = "struct(acc.st.s AS s, greatest(acc.st.e, x.e) AS e, acc.st.p AS p, acc.st.kind AS kind)"
    step = f"""CASE WHEN x.s >= acc.st.e THEN struct(x AS st, concat(acc.out, {own}) AS out)
        WHEN x.p > acc.st.p THEN struct(x AS st, acc.out AS out)
        WHEN x.p = 2D THEN struct({grown} AS st, acc.out AS out) ELSE acc END"""
    swept = _fold(both, "struct(-1 AS s, -1 AS e, -1D AS p, '' AS kind)", kind, step, f"flatten(concat(o.out, array(transform(array(struct(o.st AS st)), acc -> {own})[0])))")
    return df.selectExpr(*docs.columns, "pii_base", f"IF(size(pii_held) = 0, cast(array() AS array<{kind}>), {swept}) AS pii_added")


def all_spans() -> str:
    """SQL: the base and the added spans, by kind as listed, then start."""
    rank = ", ".join(f"'{k}'" for k in KINDS)
    both = f"transform(array_sort(transform(concat(pii_base, pii_added), x -> struct(array_position(array({rank}), x.kind) AS r, x.s AS s, x.e AS e, x.kind AS kind))), x -> struct(x.kind AS kind, x.s AS s, x.e AS e))"
    return listed(both)


def listed(column: str) -> str:
    """SQL: kind:start:end of each span, comma-joined."""
    return f"array_join(transform({column}, x -> concat(x.kind, ':', x.s, ':', x.e)), ',')"


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every found span of the text replaced by its kind in brackets; overlapping spans become one, named by the first."""
    kind = "struct<s:int,e:int,kind:string>"
    own = f"IF(acc.st.s < 0, cast(array() AS array<{kind}>), array(acc.st))"
    step = f"IF(x.s < acc.st.e, struct(struct(acc.st.s AS s, greatest(acc.st.e, x.e) AS e, acc.st.kind AS kind) AS st, acc.out AS out), struct(x AS st, concat(acc.out, {own}) AS out))"
    spans = "array_sort(transform(concat(pii_base, pii_added), x -> struct(x.s AS s, x.e AS e, x.kind AS kind)))"
    merged = _fold(spans, "struct(-1 AS s, -1 AS e, '' AS kind)", kind, step, f"flatten(concat(o.out, array(transform(array(struct(o.st AS st)), acc -> {own})[0])))")
    t = f"`{text_col}`"
    # a long text in pieces, so that the reach to a place does not grow with the place
    pieces = f"IF(size(pii_cut) = 0, cast(array() AS array<string>), transform(sequence(0, (length({t}) - 1) div {PIECE}), i -> substring({t}, i * {PIECE} + 1, {PIECE})))"
    found = find(docs, text_col).selectExpr(*[f"`{c}`" for c in docs.columns], f"{merged} AS pii_cut").selectExpr("*", f"{pieces} AS pii_piece")

    def between(a: str, z: str) -> str:
        """SQL: the text from place a to place z."""
        first, last = f"({a}) div {PIECE}", f"({z}) div {PIECE}"
        return f"""IF({first} = {last}, coalesce(substring(pii_piece[cast({first} AS int)], ({a}) % {PIECE} + 1, ({z}) - ({a})), ''),
            concat(substring(pii_piece[cast({first} AS int)], ({a}) % {PIECE} + 1), array_join(slice(pii_piece, cast({first} AS int) + 2, cast({last} - {first} AS int) - 1), ''), coalesce(left(pii_piece[cast({last} AS int)], cast(({z}) % {PIECE} AS int)), '')))"""

    before = between("IF(i = 1, 0, pii_cut[i - 2].e)", "pii_cut[i - 1].s")
    text = f"""IF(size(pii_cut) = 0, {t}, concat(
        array_join(transform(sequence(1, size(pii_cut)), i -> concat({before}, '[', upper(pii_cut[i - 1].kind), ']')), ''),
        substring({t}, pii_cut[size(pii_cut) - 1].e + 1)))"""
    return found.selectExpr(*[f"{text} AS {t}" if c == text_col else f"`{c}`" for c in docs.columns])
