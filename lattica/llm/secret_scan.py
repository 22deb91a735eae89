"""Secret scans: fixed patterns, then a battery of randomness tests, in SQL functions alone.

Base patterns are leftmost and non-overlapping for each kind.  Positions come from cutting
the text at the pattern: the lengths of the gaps and of the matches add up to offsets in
code points.

The method looks at every run of 20 or more token characters, a letter among them, that no
base span touches.
Its alphabet is inferred from the classes of characters that occur: hexadecimal; base 32 in
either case, if letters of one case and digits 2-7 alone occur; otherwise the union of those
of A-Z, a-z, 0-9 and the two signs that occur, so letters of one case, base 36, base 52, base
62 and base 64 among others.  Characters become numbers of that alphabet, and a battery asks
whether the run could be uniformly random: chi-squared over the alphabet, neighbouring
symbols pooled so that five characters fall to a cell, Wald-Wolfowitz runs about the middle,
lag-1 serial correlation, and a score of neighbouring letters that words have more of than
uniform letters, without regard to case and not for hexadecimal runs.  A run whose p-value,
the least of the four times four, is at most ``rate`` is not random.

A run is a discovery if it could not be ordinary text either.  In words, joined in any way,
pairs of letters score as in TEXT_PAIR and digits meet letters as in a Poisson law of mean
TEXT_FLIPS; the p-value of a run as text is the lesser of both tests times two.  Within a
document these p-values, divided by weights in proportion to length, go through the
Benjamini-Hochberg step-up rule at ``rate``, which bounds the share of text among the
discoveries; long runs, whose tests have more power, get more of the rate.  Discoveries
that the battery lets pass are secrets of kind ``random``.

No Python runs on executors; nothing is shuffled.

Defined results: a null or empty text has no spans and the digest of the empty string;
repeated rows give repeated results; other columns are ignored; very long texts are
scanned whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

#: Fixed values of the contract: kind, pattern, capturing group whose length counts, least length.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{32,}", 0, 32),
)
KIND = "random"
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
RATE = 0.01
#: Mean and deviation of a letter pair's score in words of several languages, joins of words included, and the mean of digit-letter borders.
TEXT_PAIR = (5.7, 2.9)
TEXT_FLIPS = 1.0
_UPPER, _LOWER, _DIGITS, _SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "+/"
#: Runs of one kind of encoding, tried in order; other runs have the classes that occur.
_ENCODINGS = (("^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"), ("^(?=.*[2-7])[A-Z2-7]+$", _UPPER + "234567"), ("^(?=.*[2-7])[a-z2-7]+$", _LOWER + "234567"))
_CLASSES = (("[A-Z]", _UPPER), ("[a-z]", _LOWER), ("[0-9]", _DIGITS), ("[+/_-]", _SIGNS))
#: Rounded, shifted logarithms of how often a letter (row) stands before another (column) inside words of English texts.
_PAIRS = (
    "06660261504768050778543240512150004306104305305000506030710650560182044650002061147031700442600244410030"
    "63675541401658255886154651400144007003006005044000303000602560022332053050000060008000600110600317600020"
    "56766650402668740678150304300040000000002000202000004102520030020111004020100071147200700610620064520050"
    "73127020600450660040410020606764705033246201784401503466375133267856085665521260126003500621650765500170"
    "00030000000000000000500000714483507054547305665320504041821570231165026762204070328309801441763667504150"
    "56445140501556050666000100500070206000002000000000005000400560010350033000200030303000200000030005000020"
    "2025301030021355044600100120004000200000100000000001"
)

_SPAN = "struct<s:int,o:int,e:int,kind:string>"


def _spans(found: str, gaps: str, sizes: str, kind: str, order: int, least: int) -> Column:
    """Spans of the matches whose measured group has ``least`` characters or more."""
    start = f"a.at + length(x.{gaps})"
    end = f"{start} + length(x.{found})"
    span = f"named_struct('s', {start}, 'o', {order}, 'e', {end}, 'kind', '{kind}')"
    # in runs of 256 matches, whose results are joined at the end: work stays in proportion to the matches
    return F.expr(f"""
        if(size({found}) = 0, cast(array() as array<{_SPAN}>),
          flatten(aggregate(transform(sequence(0, (size({found}) - 1) div 256), c -> slice(arrays_zip({gaps}, {found}, {sizes}), 256 * c + 1, 256)),
            named_struct('at', 0, 'out', cast(array() as array<array<{_SPAN}>>)),
            (b, some) -> transform(array(aggregate(some, named_struct('at', b.at, 'out', cast(array() as array<{_SPAN}>)),
              (a, x) -> if(x.{found} is null, a,
                named_struct('at', {end}, 'out', if(length(x.{sizes}) >= {least}, concat(a.out, array({span})), a.out))))),
              r -> named_struct('at', r.at, 'out', concat(b.out, array(r.out))))[0],
            b -> b.out)))""")


def _upper_tail(z: str) -> str:
    """P(Z > z) for a standard normal, by a rational approximation good to about 1e-7."""
    x = f"abs({z})"
    t = f"(1 / (1 + 0.2316419D * {x}))"
    poly = f"({t} * (0.319381530D + {t} * (-0.356563782D + {t} * (1.781477937D + {t} * (-1.821255978D + {t} * 1.330274429D)))))"
    tail = f"(0.3989422804014327D * exp(-{x} * {x} / 2) * {poly})"
    return f"if({z} >= 0, {tail}, 1 - {tail})"


def _pair_moments() -> tuple[float, float, float]:
    """Mean and variance of the score of a pair of uniform letters, and covariance of two pairs that share a letter."""
    rows = [[int(c) for c in _PAIRS[26 * i : 26 * i + 26]] for i in range(26)]
    mean = sum(map(sum, rows)) / 676
    shared = sum(sum(r[b] for r in rows) * sum(rows[b]) for b in range(26)) / 26**3 - mean * mean
    return mean, sum((x - mean) ** 2 for r in rows for x in r) / 676, shared


def _flip_tail(d: str) -> str:
    """P(X >= d) for a Poisson law of mean TEXT_FLIPS; from 20 on as at 20."""
    tails, rest = [], 1.0
    for k in range(21):
        tails.append(max(rest, 1e-18))
        rest -= math.exp(-TEXT_FLIPS) * TEXT_FLIPS**k / math.factorial(k)
    return f"element_at(array({', '.join(f'{t!r}D' for t in tails)}), cast(least({d}, 20) as int) + 1)"


def randomness(token: str) -> str:
    """SQL for a struct of ``random`` and ``text``, the p-values of the battery and as ordinary text, of a column or lambda variable with 20 characters or more."""
    mean, spread, shared = _pair_moments()
    cases = "".join(f"when {token} rlike '{p}' then '{a}' " for p, a in _ENCODINGS)
    classes = ", ".join(f"if({token} rlike '{p}', '{a}', '')" for p, a in _CLASSES)
    alphabet = f"case {cases}else concat({classes}) end"
    # v: each character's number in its alphabet; the url-safe signs stand for + and /
    numbers = f"""transform(array({alphabet}), a -> named_struct(
        'k', length(a), 'n', length({token}),
        'v', transform(sequence(1, length({token})), i -> locate(translate(if(length(a) = 16, lower(substr({token}, i, 1)), substr({token}, i, 1)), '-_', '+/'), a) - 1)))[0]"""
    # l: letters from 0 to 25, others -1; three letters in a row are two pairs that share one
    letters = f"""transform(array({numbers}), y -> named_struct('k', y.k, 'n', y.n, 'v', y.v,
        'l', transform(sequence(1, y.n), i -> locate(lower(substr({token}, i, 1)), '{_LOWER}') - 1)))[0]"""
    pairs = f"""transform(array({letters}), y -> named_struct('k', y.k, 'n', y.n, 'v', y.v,
        'cells', cast(greatest(4, least(y.k, y.n div 5)) as int),
        'flips', size(filter(sequence(1, y.n - 1), i -> substr({token}, i, 2) rlike '[0-9][A-Za-z]|[A-Za-z][0-9]')),
        'pairs', if(y.k = 16, 0D, aggregate(sequence(1, y.n - 1), 0D, (s, i) -> s + if(y.l[i - 1] >= 0 and y.l[i] >= 0, 1D, 0D))),
        'triples', aggregate(sequence(2, y.n - 1), 0D, (s, i) -> s + if(y.l[i - 2] >= 0 and y.l[i - 1] >= 0 and y.l[i] >= 0, 1D, 0D)),
        'score', aggregate(sequence(1, y.n - 1), 0D, (s, i) -> s + if(y.l[i - 1] >= 0 and y.l[i] >= 0, ascii(substr('{_PAIRS}', 26 * y.l[i - 1] + y.l[i] + 1, 1)) - 48 - {mean}D, 0D))))[0]"""
    pairs = f"""transform(array({pairs}), y -> named_struct('k', y.k, 'n', y.n, 'v', y.v, 'cells', y.cells, 'flips', y.flips, 'pairs', y.pairs, 'triples', y.triples, 'score', y.score,
        'z5', ({TEXT_PAIR[0] - mean}D * y.pairs - y.score) / ({TEXT_PAIR[1]}D * sqrt(greatest(1D, y.pairs)))))[0]"""
    counts = f"""transform(array({pairs}), y -> named_struct('k', y.k, 'n', y.n, 'v', y.v,
        'text', least(1D, 2 * least({_flip_tail('y.flips')}, if(y.pairs = 0, 1D, {_upper_tail('y.z5')}))),
        'z4', if(y.pairs = 0, -9D, y.score / sqrt(y.pairs * {spread}D + 2 * y.triples * {shared}D)),
        'mean', aggregate(y.v, 0D, (s, x) -> s + x) / y.n,
        'above', aggregate(y.v, 0D, (s, x) -> s + if(2 * x >= y.k, 1D, 0D)),
        'runs', aggregate(sequence(2, y.n), 1D, (s, i) -> s + if((2 * y.v[i - 1] >= y.k) <> (2 * y.v[i - 2] >= y.k), 1D, 0D)),
        'df', y.cells - 1D,
        'chi', aggregate(sequence(0, y.cells - 1), 0D, (s, b) -> s + transform(array(y.n * (((b + 1) * y.k + y.cells - 1) div y.cells - (b * y.k + y.cells - 1) div y.cells) / y.k), e ->
            pow(size(filter(y.v, x -> x * y.cells div y.k = b)) - e, 2) / e)[0])))[0]"""
    moments = f"""transform(array({counts}), y -> named_struct('n', y.n, 'runs', y.runs, 'chi', y.chi, 'df', y.df, 'z4', y.z4, 'text', y.text,
        'expected', 2 * y.above * (y.n - y.above) / y.n + 1,
        'var', aggregate(y.v, 0D, (s, x) -> s + pow(x - y.mean, 2)),
        'cov', aggregate(sequence(2, y.n), 0D, (s, i) -> s + (y.v[i - 1] - y.mean) * (y.v[i - 2] - y.mean))))[0]"""
    scores = f"""transform(array({moments}), y -> named_struct('z4', y.z4, 'text', y.text,
        'z1', (pow(y.chi / y.df, 1 / 3D) - (1 - 2 / (9 * y.df))) / sqrt(2 / (9 * y.df)),
        'z2', if(y.expected <= 2, 99D, abs(y.runs - y.expected) / sqrt((y.expected - 1) * (y.expected - 2) / (y.n - 1))),
        'z3', if(y.var = 0, 99D, abs(y.cov / y.var) * sqrt(y.n))))[0]"""
    return f"transform(array({scores}), y -> named_struct('text', y.text, 'random', least(1D, 4 * least({_upper_tail('y.z1')}, 2 * {_upper_tail('y.z2')}, 2 * {_upper_tail('y.z3')}, {_upper_tail('y.z4')}))))[0]"


def find_secrets(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE, keep: tuple[str, ...] = ()) -> DataFrame:
    """``base`` and ``spans``, arrays of (s, o, e, kind) in order, for each row; and the columns in ``keep``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("__id"), text.alias("__text"), *(F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)))
    held = ["__id", "__text", *(f"__k{i}" for i in range(len(keep)))]
    kinds = [*BASE, (KIND, TOKEN, 0, 20)]
    matches = rows.select(
        *held,
        *(F.regexp_extract_all("__text", F.lit(p), F.lit(0)).alias(f"__m{i}") for i, (_, p, _, _) in enumerate(kinds)),
    )
    cut = matches.select(
        "*",
        *(F.when(F.size(f"__m{i}") > 0, F.split("__text", p, -1)).alias(f"__g{i}") for i, (_, p, _, _) in enumerate(kinds)),
        *(
            (F.when(F.size(f"__m{i}") > 0, F.regexp_extract_all("__text", F.lit(p), F.lit(g))) if g else F.col(f"__m{i}")).alias(f"__k_{i}")
            for i, (_, p, g, _) in enumerate(kinds)
        ),
    )
    spans = cut.select(*held, f"__m{len(BASE)}", *(_spans(f"__m{i}", f"__g{i}", f"__k_{i}", k, i, n).alias(f"__s{i}") for i, (k, _, _, n) in enumerate(kinds)))
    last = len(BASE)
    base = F.array_sort(F.concat(*(f"__s{i}" for i in range(last))))
    open_runs = F.expr(f"""if(size(__s{last}) = 0, cast(array() as array<struct<t:string,span:{_SPAN}>>),
        filter(transform(__s{last}, (x, i) -> named_struct('t', __m{last}[i], 'span', x)),
          y -> y.t rlike '[A-Za-z]' and not exists(__base, b -> b.s < y.span.e and y.span.s < b.e)))""")
    runs = spans.withColumn("__base", base).withColumn("__runs", open_runs)
    scored = runs.withColumn("__p", F.expr(f"transform(__runs, r -> named_struct('span', r.span, 'p', {randomness('r.t')}, 'n', cast(length(r.t) as double)))"))
    weighted = scored.withColumn("__q", F.expr("transform(array(aggregate(__p, 0D, (s, y) -> s + y.n) / greatest(1, size(__p))), m -> transform(__p, x -> x.p.text * m / x.n))[0]"))
    limit = F.expr(f"aggregate(transform(array_sort(__q), (q, i) -> if(q <= {rate}D * (i + 1) / size(__q), q, -1D)), -1D, (s, x) -> greatest(s, x))")
    kept = F.expr(f"transform(filter(transform(__p, (x, i) -> named_struct('span', x.span, 'q', __q[i], 'p', x.p.random)), y -> y.q <= __limit and y.p > {rate}D), y -> y.span)")
    out = weighted.withColumn("__limit", limit).withColumn("__added", kept)
    return out.select(
        F.col("__id").alias(id_col),
        F.col("__text"),
        *(F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)),
        F.col("__base").alias("base"),
        F.array_sort(F.concat("__base", "__added")).alias("spans"),
    )


def render(name: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.expr(f"array_join(transform({name}, x -> concat_ws(':', x.kind, x.s, x.e)), ',')")


def redact(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """df with every span of every text replaced by ``mark`` and ``n_chars``, where there is one, counted again.

    Overlapping spans become one mark.  Null texts stay null; all columns stay.
    """
    marked = df.withColumn("__row", F.struct(*df.columns))
    found = find_secrets(marked, id_col=id_col, text_col=text_col, keep=("__row",))
    clean = F.expr(f"""if(size(spans) = 0, __text, aggregate(spans, named_struct('at', 0, 'out', ''),
        (a, x) -> if(x.s >= a.at,
          named_struct('at', x.e, 'out', concat(a.out, substr(__text, a.at + 1, x.s - a.at), '{mark}')),
          named_struct('at', greatest(a.at, x.e), 'out', a.out)),
        a -> concat(a.out, substr(__text, a.at + 1))))""")
    text = F.when(F.col(f"__row.{text_col}").isNotNull(), clean)
    out = found.withColumn("__clean", text)
    changed = {text_col: F.col("__clean"), "n_chars": F.when(F.size("spans") > 0, F.length("__clean").cast("long")).otherwise(F.col("__row.n_chars")) if "n_chars" in df.columns else None}
    return out.select(*((changed[c] if c in changed else F.col("__row")[c]).alias(c) for c in df.columns))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(read_table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k, *_ in BASE]
    return found.select("doc_id", *counts, F.sha2(render("base"), 256).alias("base_sha256"), render("spans").alias("spans"))
