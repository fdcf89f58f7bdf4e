"""Linking variant spellings of names typed by people to registry entities.

Method.  Names are folded (case, Turkish letters, marks, punctuation) and cut
into tokens.  Candidates come from a prefix-filtered set-similarity join on
token q-grams.  The prefix of a registry name is its rarest token (also run
together with another of its tokens): a typed name can only mean it if one of
its tokens, or two neighbouring ones, is close to that.  Tokens are joined on
their q-grams once per distinct token, filtered by length, position and number
of shared q-grams, which no pair within the edit distance asked for can fail.
An abbreviated rarest token is reached over another naming token of the name.

Candidates are verified by a soft weighted token similarity: tokens are
aligned one to one by edit distance, abbreviation, initial or glued parts, and
rare tokens count more, in both directions.  Which tokens name nothing is
learnt: kinds of venue are frequent in the registry, qualifiers of a pitch
stand beside many different names in the typed strings and in no name.  Each
distinct typed string is handled once, however many records have it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinelake.session import BROADCAST_ROWS, cut, join_small, map_arrow

#: Letters folded to their plain form before comparison.
FOLD_FROM = "ıİşŞğĞüÜöÖçÇâÂîÎûÛéáíóúñäßQ"
FOLD_TO = "iissgguuooccaaiiuueaiounasq"


@dataclass(frozen=True)
class NameParams:
    accept: float = 0.62  #: least score of a link
    margin: float = 0.02  #: least lead over the best other entity
    least_rare: float = 0.68  #: least similarity of the registry name's rarest token
    generic_share: float = 0.1  #: tokens in at least this share of the registry's names are generic
    phrase_share: float = 0.03  #: and from this share on those that stand beside one generic token
    phrase: float = 0.9  #: in this share of their names
    least_spread: int = 3  #: names beside which a token that is in no name has to stand to name nothing


def folded(c: Column) -> Column:
    """Plain lower-case tokens separated by single spaces; a change from small
    to capital letter separates tokens too."""
    s = F.regexp_replace(c, r"\p{M}", "")
    s = F.regexp_replace(s, r"(\p{Ll})(\p{Lu})", "$1 $2")
    s = F.lower(F.translate(s, FOLD_FROM, FOLD_TO))
    return F.trim(F.regexp_replace(s, r"[^\p{L}\p{N}]+", " "))


def _gram_rows(strings: DataFrame, c: str, kind: str) -> DataFrame:
    """c, kind, n, pos, g: bigrams of each string with its ends marked, and its length."""
    marked = strings.where(F.length(c) >= 3).select(c, kind, F.concat(F.lit("^"), F.col(c), F.lit("$")).alias("m"))
    at = F.expr("posexplode(transform(sequence(1, length(m) - 1), i -> substring(m, i, 2)))")
    return marked.select(c, kind, F.length(c).alias("n"), at.alias("pos", "g"))


@lru_cache(maxsize=1 << 15)
def edit_distance(a: str, b: str) -> int:
    """Optimal string alignment distance: insert, delete, replace, swap neighbours."""
    if a == b:
        return 0
    prev2: list[int] = []
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, prev2[j - 2] + 1)
            row.append(d)
        prev2, prev = prev, row
    return prev[-1]


def _within(short: str, long: str) -> bool:
    it = iter(long)
    return all(c in it for c in short)


@lru_cache(maxsize=1 << 16)
def token_similarity(t: str, r: str) -> float:
    """How well the typed token t stands for the registry token r, 0 to 1."""
    if t == r:
        return 1.0
    if not t or not r:
        return 0.0
    n, m = len(t), len(r)
    best = 0.0
    if n < m and r.startswith(t):
        best = 0.62 if n == 1 else 0.8 if n <= 3 else 0.92
    elif 2 <= n < m and t[0] == r[0] and m - n >= 2 and _within(t, r):
        best = 0.7
    if n >= 3 and m >= 3 and abs(n - m) <= 3:
        s = 1.0 - edit_distance(t, r) / max(n, m)
        if s >= 0.5:
            best = max(best, s)
    return best


class Generic:
    """Tokens of kinds of venue and the like; they identify nothing."""

    def __init__(self, tokens: list[str]) -> None:
        self.tokens = frozenset(tokens)
        self.all = tuple(sorted(tokens)) + tuple(a + b for a in sorted(tokens) for b in sorted(tokens) if a != b)
        self.known: dict[str, bool] = {}

    def like(self, token: str) -> bool:
        """A typed token that may stay unmatched: it stands for a generic one, or is too short to name anything."""
        if token not in self.known:
            if len(self.known) > 1 << 16:
                self.known.clear()
            self.known[token] = len(token) <= 2 or any(token_similarity(token, g) >= 0.6 for g in self.all)
        return self.known[token]


def soft_score(typed: list[str], name: list[str], w_name: list[float], generic: Generic, p: NameParams, idle: frozenset[str] = frozenset()) -> float:
    """Mean of the covered token weights of both sides, 0 if the name is not meant.

    Tokens are aligned greedily by weighted similarity; two neighbouring typed
    tokens, or a typed token of two names run together, may stand for one
    another.  Every token of the name of more than two letters that is not
    generic has to be found, or the first two of them, the rarest one closely,
    and no naming token of the typed side may be left over; ``idle`` ones name
    nothing.
    """
    top = max(range(len(name)), key=lambda j: w_name[j])
    parts = [(t, (i,)) for i, t in enumerate(typed)] + [(typed[i] + typed[i + 1], (i, i + 1)) for i in range(len(typed) - 1)]
    options: list[tuple[float, tuple[int, ...], tuple[int, ...], float]] = []
    for t, at in parts:  # the rarest token first: most candidates end here
        least = p.least_rare if len(at) == 1 else max(0.75, p.least_rare)
        s = token_similarity(t, name[top])
        if s >= least:
            options.append((s * w_name[top], at, (top,), s))
        if len(at) == 1 and len(t) > len(name[top]):
            for j, r in enumerate(name):
                if j != top:
                    for glued in (name[top] + r, r + name[top]):
                        s = token_similarity(t, glued) if len(t) >= 0.75 * len(glued) else 0.0
                        if s >= 0.8:
                            options.append((s * (w_name[top] + w_name[j]), at, (top, j), s))
    if not options:
        return 0.0
    for j, r in enumerate(name):
        if j != top:
            for t, at in parts:
                s = token_similarity(t, r)
                if s >= (0.6 if len(at) == 1 else 0.75):
                    options.append((s * w_name[j], at, (j,), s))
    options.sort(key=lambda o: -o[0])
    got_name = [0.0] * len(name)
    got_typed = [0.0] * len(typed)
    weight_typed = [0.0] * len(typed)
    for _, ti, nj, s in options:
        if any(weight_typed[i] for i in ti) or any(got_name[j] for j in nj):
            continue
        for j in nj:
            got_name[j] = s
        for i in ti:
            got_typed[i] = s
            weight_typed[i] = sum(w_name[j] for j in nj) / len(ti)
    naming = [len(n) > 2 and n not in generic.tokens for n in name]
    # people drop the tail of a name: it may be missing where two naming tokens begin the name
    needed = name[:2] if len(name) > 2 and all(naming[:2]) and all(got_name[:2]) else name
    if not got_name[top] or any(not g and k for g, k, _ in zip(got_name, naming, needed)):
        return 0.0
    for i, t in enumerate(typed):
        if not weight_typed[i]:
            if t not in idle and not generic.like(t):
                return 0.0
            weight_typed[i] = 0.15
    covered_name = sum(s * w for s, w in zip(got_name, w_name)) / sum(w_name)
    covered_typed = sum(s * w for s, w in zip(got_typed, weight_typed)) / sum(weight_typed)
    return (covered_name + covered_typed) / 2


def _generic_tokens(names: DataFrame, df: DataFrame, n_names: int, p: NameParams) -> list[str]:
    """Frequent tokens of the registry, and those bound to one of them.

    Bounded: a name of k tokens adds k to the sum of frequencies, so at most
    mean(k) / phrase_share tokens can be that frequent, whatever the registry's size."""
    frequent = F.broadcast(df.where(F.col("df") >= p.generic_share * n_names).where("df > 2").select(F.col("t").alias("beside")))
    toks = names.select("f").distinct().select(F.split("f", " ").alias("a"))
    pairs = toks.select(F.explode(F.expr("flatten(transform(sequence(0, size(a) - 1), i -> filter(array(struct(a[i] AS t, get(a, i - 1) AS beside), struct(a[i] AS t, get(a, i + 1) AS beside)), x -> x.beside IS NOT NULL)))")).alias("x")).select("x.t", "x.beside")
    bound = pairs.join(frequent, "beside").groupBy("t", "beside").agg(F.count(F.lit(1)).alias("n")).join(df, "t").where((F.col("n") >= p.phrase * F.col("df")) & (F.col("df") >= p.phrase_share * n_names) & (F.col("df") > 2))
    return sorted({r["t"] for r in frequent.select(F.col("beside").alias("t")).unionByName(bound.select("t")).distinct().collect()})


def similar_tokens(parts: DataFrame, targets: DataFrame, p: NameParams) -> DataFrame:
    """part, target: pairs of strings close enough by edit distance, and equal ones.

    ``parts``: part, double (two neighbours); ``targets``: target, glued.  The
    more a string is put together, the closer it has to be.  A swap of
    neighbours touches three of a string's n + 1 marked bigrams, any other edit
    fewer, and shifts positions by at most one: pairs that share fewer or lie
    further apart are never looked at."""
    small = cut(_gram_rows(targets, "target", "glued").withColumnsRenamed({"n": "m", "pos": "at"}))
    least = F.when(F.col("glued"), 0.8).when(F.col("double"), max(0.75, p.least_rare)).otherwise(p.least_rare)
    longer = F.greatest("n", "m")
    d = F.floor(longer * (1 - least) + 1e-9)
    near = ~(F.col("glued") & F.col("double")) & (F.abs(F.col("n") - F.col("m")) <= d) & (F.abs(F.col("pos") - F.col("at")) <= d)
    hits = join_small(_gram_rows(parts, "part", "double"), small, "g", "inner").where(near).groupBy("part", "double", "n", "target", "glued", "m").agg(F.count(F.lit(1)).alias("shared"))
    close = hits.where(F.col("shared") >= longer + 1 - 3 * d).select("part", "target", least.alias("least"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = [i for i, (x, y, at_least) in enumerate(zip(*(c.to_pylist() for c in b.columns))) if token_similarity(x, y) >= at_least]
            yield b.take(pa.array(k, pa.int64())).select(["part", "target"])

    short = parts.where(F.length("part") < 3).join(targets, F.col("part") == F.col("target")).select("part", "target")
    return map_arrow(close, verify, "part string, target string").unionByName(short)


def _targets(names: DataFrame, generic: list[str]) -> DataFrame:
    """target, rid, top, main, glued: what a typed token may stand for in a
    name: its rarest token, that one glued to another (both main), or another
    naming token."""
    g = F.array(*[F.lit(t) for t in generic]).cast("array<string>")
    n = names.select("rid", "top", F.split("f", " ").alias("a"), g.alias("g"))
    others = "filter(a, t -> t <> top)"

    def rows(array: str, main: bool, glued: bool) -> DataFrame:
        return n.select("rid", "top", F.expr(f"explode(array_distinct({array}))").alias("target"), F.lit(main).alias("main"), F.lit(glued).alias("glued"))

    runs = f"flatten(transform({others}, t -> array(concat(top, t), concat(t, top))))"
    return rows("array(top)", True, False).unionByName(rows(runs, True, True)).unionByName(rows(f"filter({others}, t -> NOT array_contains(g, t))", False, False))


def candidates(forms: DataFrame, names: DataFrame, generic: list[str], p: NameParams) -> DataFrame:
    """qid, rid of typed forms and registry names that are worth comparing."""
    toks = forms.select("qid", F.split("f", " ").alias("a"))
    pairs = "transform(filter(sequence(1, size(a)), i -> i < size(a)), i -> struct(concat(a[i - 1], a[i]) AS part, true AS double))"
    both = F.expr(f"concat(transform(a, t -> struct(t AS part, false AS double)), {pairs})")
    parts = cut(toks.select("qid", "a", F.explode(F.array_distinct(both)).alias("x")).select("qid", "a", "x.part", "x.double"))
    targets = cut(_targets(names, generic))
    once = cut(parts.select("part", "double").distinct())
    alike = similar_tokens(once, targets.select("target", "glued").distinct(), p)
    # the start of the rarest token, four letters or more, is as good as all of it
    starts = targets.where("main AND NOT glued AND length(target) > 4").select("target").distinct().withColumn("part", F.explode(F.expr("transform(sequence(4, length(target) - 1), i -> substring(target, 1, i))")))
    alike = cut(alike.unionByName(starts.select("part", "target").join(once, "part", "left_semi")).distinct())
    meant = join_small(parts, alike, "part", "inner")
    # a name is reached over its rarest token, or over another one if something typed may abbreviate the rarest
    short = F.expr("exists(a, t -> substring(t, 1, 1) = substring(top, 1, 1) AND length(t) < length(top))")
    return join_small(meant, targets, "target", "inner").where(F.col("main") | short).select("qid", "rid").distinct()


def idle_tokens(forms: DataFrame, names: DataFrame, p: NameParams) -> DataFrame:
    """qid, idle: tokens of each typed form that are in no name of the registry
    but stand beside the rarest tokens of at least ``least_spread`` names."""
    toks = cut(forms.select("qid", F.explode(F.array_distinct(F.split("f", " "))).alias("t")))
    tops = cut(names.select(F.col("top").alias("t")).distinct())
    named = join_small(toks, tops, "t", "inner").select("qid", F.col("t").alias("top")).distinct()
    vocabulary = cut(names.select(F.explode(F.split("f", " ")).alias("t")).distinct())
    free = join_small(toks, vocabulary, "t", "left_anti")
    spread = cut(free.join(named, "qid").groupBy("t").agg(F.countDistinct("top").alias("n")).where(F.col("n") >= p.least_spread).select("t"))
    return join_small(free, spread, "t", "inner").groupBy("qid").agg(F.collect_set("t").alias("idle"))


def link_names(typed: DataFrame, registry: DataFrame, params: NameParams = NameParams()) -> DataFrame:
    """The registry entity each typed name means.

    ``typed``: name string; ``registry``: entity string, name string (several
    per entity).  Output: name, entity, score for every distinct typed name
    with an accepted link.  Null, blank and letterless names never link;
    registry rows with a null or empty entity or name are left out; ties and
    near ties between entities link to none; other columns are ignored; empty
    tables give an empty result.
    """
    p = params
    names = registry.where("entity is not null and trim(entity) <> ''").select("entity", folded(F.col("name")).alias("f")).where("f is not null and f <> ''").distinct()
    names = cut(names.withColumn("rid", F.xxhash64("entity", "f")))
    strings = typed.select("name").where("name is not null").distinct().withColumn("f", folded(F.col("name"))).where("f <> ''")
    queries = cut(strings.select("name", "f", F.xxhash64("f").alias("qid")))
    forms = cut(queries.select("qid", "f").distinct())
    n_names = max(1, names.select("f").distinct().count())
    df = cut(names.select("f").distinct().select(F.explode(F.array_distinct(F.split("f", " "))).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")))
    generic_list = _generic_tokens(names, df, n_names, p)
    generic = Generic(generic_list)
    # weights of a name's tokens in order; its rarest token is the first of the heaviest
    at = names.select("rid", F.posexplode(F.split("f", " ")).alias("pos", "t"))
    weighed = join_small(at, df, "t", "inner").groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("pos", "df"))).alias("k"), F.min(F.struct("df", "pos", "t")).alias("rarest"))
    names = cut(names.join(weighed, "rid").select("rid", "entity", "f", F.col("rarest.t").alias("top"), F.transform("k", lambda x: F.log1p(F.lit(float(n_names)) / x["df"])).alias("w")))
    hits = candidates(forms, names, generic_list, p)
    side = cut(names.select("rid", "entity", F.col("f").alias("rf"), "w"))
    pairs = join_small(hits, side, "rid", "inner").join(forms.join(idle_tokens(forms, names, p), "qid", "left"), "qid").select("qid", "f", "idle", "entity", "rf", "w")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, f, idle, _, rf, w = (c.to_pylist() for c in b.columns)
            scores = [soft_score(f[i].split(" "), rf[i].split(" "), w[i], generic, p, frozenset(idle[i] or ())) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), pa.array(scores, pa.float64())], ["qid", "entity", "score"])

    scored = map_arrow(pairs, verify, "qid bigint, entity string, score double").where("score > 0")
    best = scored.groupBy("qid", "entity").agg(F.max("score").alias("score"))
    rank = Window.partitionBy("qid").orderBy(F.desc("score"), "entity")
    lead = best.withColumn("k", F.row_number().over(rank)).withColumn("next", F.lead("score").over(rank)).where("k = 1")
    accepted = lead.where((F.col("score") >= p.accept) & (F.col("score") - F.coalesce("next", F.lit(0.0)) >= p.margin)).select("qid", "entity", "score")
    return queries.join(accepted, "qid").select("name", "entity", "score")


def registry_names(cameras: DataFrame) -> DataFrame:
    """entity, name: venue names and aliases of the cameras that have a venue."""
    placed = cameras.where("venue_id is not null and trim(venue_id) <> ''")
    own = placed.select(F.col("venue_id").alias("entity"), F.col("venue_name").alias("name"))
    return own.unionByName(placed.select(F.col("venue_id").alias("entity"), F.explode("aliases").alias("name"))).where("name is not null").distinct()


def link_venues(matches: DataFrame, cameras: DataFrame, params: NameParams = NameParams()) -> DataFrame:
    """kind, record_key, name, venue_id, exact, score: every match record and
    every camera without venue whose typed name means a venue of the registry.
    ``exact``: the name is, byte for byte, a venue name or alias (of one venue)."""
    reg = cut(registry_names(cameras))
    m = matches.where("id is not null").select(F.lit("match").alias("kind"), F.col("id").cast("string").alias("record_key"), F.col("venue").alias("name"))
    c = cameras.where("camera_id is not null and (venue_id is null or trim(venue_id) = '')").select(F.lit("camera").alias("kind"), F.col("camera_id").alias("record_key"), F.col("venue_name").alias("name"))
    records = m.unionByName(c).distinct()
    exact = reg.groupBy("name").agg(F.min("entity").alias("venue_id"), F.countDistinct("entity").alias("k"))
    # exact strings need no search; the remaining distinct ones are linked once each
    open_names = records.select("name").distinct().join(exact.select("name"), "name", "left_anti")
    linked = link_names(open_names, reg, params).withColumnRenamed("entity", "venue_id").withColumn("exact", F.lit(False))
    known = exact.where("k = 1").select("name", "venue_id", F.lit(1.0).alias("score"), F.lit(True).alias("exact"))
    by_name = cut(linked.select("name", "venue_id", "score", "exact").unionByName(known))
    if by_name.count() <= BROADCAST_ROWS:
        by_name = F.broadcast(by_name)
    return records.join(by_name, "name").select("kind", "record_key", "name", "venue_id", "exact", "score")
