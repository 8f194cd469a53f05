"""Groups of units as binary variables, discrete networks over them, and typical scenarios.

Counting is done in Spark over sparse rows; networks have tens of nodes, so edges, tables and searches over them are small.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import MACROS, confident, severity_name, severity_rank, topic_variable

RANK = {m: i for i, m in enumerate(MACROS)} | {"Severity": len(MACROS)}


def topic_support(units: DataFrame, least_confidence: float = 0.5) -> DataFrame:
    """A7, A8. (z_hat, macro, support): support counts distinct accidents with a confident unit of the topic; its macro is
    the most frequent over all its units, ties to the least. Null topics and accidents don't count."""
    rows = units.where("z_hat is not null and accident_id is not null")
    counts = rows.where("macro is not null").groupBy("z_hat", "macro").count()
    w = Window.partitionBy("z_hat").orderBy(F.desc("count"), "macro")
    macro = counts.withColumn("r", F.row_number().over(w)).where("r = 1").select("z_hat", "macro")
    sure = rows.where(confident(F.col("z_confidence"), least_confidence)).groupBy("z_hat").agg(F.count_distinct("accident_id").alias("support"))
    return macro.join(sure, "z_hat", "left").withColumn("support", F.coalesce("support", F.lit(0)))


def selected_topics(support: DataFrame, accidents: int, per_macro: int = 6, least: int = 20) -> DataFrame:
    """W4, A38. (z_hat, macro, support, variable, share): the topics of most support of each macro, ties to the least topic."""
    w = Window.partitionBy("macro").orderBy(F.desc("support"), "z_hat")
    kept = support.where(F.col("support") >= least).withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_macro).drop("r")
    return kept.withColumn("variable", topic_variable(F.col("z_hat"), F.col("macro"))).withColumn("share", F.col("support") / max(1, accidents))


def severity_by_accident(units: DataFrame) -> DataFrame:
    """A11. (accident_id, severity_ord, severity_label): the worst over all units of the accident, unknown as none."""
    worst = units.where("accident_id is not null").groupBy("accident_id").agg(F.max(severity_rank(F.col("severity"))).alias("severity_ord"))
    return worst.withColumn("severity_label", severity_name(F.col("severity_ord")))


def accident_long(units: DataFrame, selected: DataFrame, least_confidence: float = 0.5) -> DataFrame:
    """G1, A9. (accident_id, variable): the selected topics that an accident has a confident unit of, once each."""
    rows = units.where(confident(F.col("z_confidence"), least_confidence) & F.col("accident_id").isNotNull()).select("accident_id", "z_hat").distinct()
    return rows.join(F.broadcast(selected.select("z_hat", "variable")), "z_hat").select("accident_id", "variable")  # at most per_macro x labels topics


def accident_matrix(units: DataFrame, selected: DataFrame, least_confidence: float = 0.5, high: int = 2) -> DataFrame:
    """G1, A10, H13. One row an accident: a 0/1 column a selected topic, a 0/1 column M_ a macro with selected topics,
    severity_ord, severity_label, severity_high. All accidents are kept, also without a confident unit."""
    names = [r[0] for r in selected.select("variable").orderBy("variable").collect()]  # few
    long = accident_long(units, selected, least_confidence)
    wide = severity_by_accident(units)
    if names:
        wide = wide.join(long.withColumn("one", F.lit(1)).groupBy("accident_id").pivot("variable", names).agg(F.max("one")), "accident_id", "left").fillna(0, names)
    for m in MACROS:
        mine = [n for n in names if n.endswith(f"_{m}")]
        if mine:
            wide = wide.withColumn(f"M_{m}", F.greatest(*map(F.col, mine)) if len(mine) > 1 else F.col(mine[0]))
    return wide.withColumn("severity_high", (F.col("severity_ord") >= high).cast("int"))


def varying(df: DataFrame, columns: list[str]) -> list[str]:
    """P15. The columns with at least two values, null as a value, in one pass."""
    if not columns:
        return []
    r = df.agg(*[(F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(c) for c in columns]).first()
    return [c for c in columns if (r[c] or 0) >= 2]


def forbidden(spark: SparkSession, nodes: dict[str, str]) -> DataFrame:
    """G2, J8. (parent, child) arcs against the order of macros: out of a severity node, or to a macro of lower rank. nodes: name to macro."""
    t = spark.createDataFrame([(n, RANK[m]) for n, m in sorted(nodes.items())], "name string, rank int")
    p, c = t.select(F.col("name").alias("parent"), F.col("rank").alias("p")), t.select(F.col("name").alias("child"), F.col("rank").alias("c"))
    top = RANK["Severity"]
    return p.crossJoin(c).where((F.col("parent") != F.col("child")) & ((F.col("p") == top) | ((F.col("c") != top) & (F.col("p") > F.col("c"))))).select("parent", "child")  # nodes of one network


def family_counts(df: DataFrame, node: str, parents: list[str]) -> DataFrame:
    """Counts by the states of parents and node; null counts as 0."""
    cols = [F.coalesce(F.col(c).try_cast("int"), F.lit(0)).alias(c) for c in [*parents, node]]
    return df.select(*cols).groupBy(*parents, node).count()


def conditional_table(df: DataFrame, node: str, parents: list[str], sample_size: float = 5.0) -> DataFrame:
    """G6. (parents..., node, n, p) on the full grid of states 0 and 1: (n + ess/(r q)) / (N + ess/q); sample_size 0 gives relative
    frequencies, uniform where a parent state is missing."""
    spark = df.sparkSession
    grid = spark.createDataFrame(list(itertools.product((0, 1), repeat=len(parents) + 1)), ", ".join(f"{c} int" for c in [*parents, node]))
    q = 2 ** len(parents)
    n = grid.join(family_counts(df, node, parents), [*parents, node], "left").select(*parents, node, F.coalesce("count", F.lit(0)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*parents))
    p = (F.col("n") + sample_size / (2 * q)) / (total + sample_size / q) if sample_size > 0 else F.coalesce(F.try_divide(F.col("n"), total), F.lit(0.5))
    return n.withColumn("p", p)


def chain_marginals(df: DataFrame, chain: list[str], sample_size: float = 5.0) -> DataFrame:
    """G5, G7. (node, p1): P(node = 1) along a chain, by joining each table with the marginal of its parent."""
    from ..session import cut

    spark = df.sparkSession
    df = cut(df.select(*chain))
    out, p1 = [], None
    for i, node in enumerate(chain):
        rows = conditional_table(df, node, chain[i - 1 : i] if i else [], sample_size).where(F.col(node) == 1).collect()  # at most two rows
        p1 = rows[0].p if not i else sum(r.p * (p1 if r[chain[i - 1]] else 1 - p1) for r in rows)
        out.append((node, float(p1)))
    return spark.createDataFrame(out, "node string, p1 double")


def mean_over_parents(table: DataFrame, node: str) -> DataFrame:
    """G9. (state, p): unweighted mean over parent states, which is not the marginal."""
    return table.groupBy(F.col(node).alias("state")).agg(F.avg("p").alias("p"))


def lifts(df: DataFrame, edges: list[tuple[str, str]]) -> DataFrame:
    """G8. (parent, child, p_child, p_child_given_parent, lift) from counts in one pass; no row where P(child) or the parent never is."""
    spark = df.sparkSession
    if not edges:
        return spark.createDataFrame([], "parent string, child string, p_child double, p_child_given_parent double, lift double")
    one = lambda c: F.coalesce(F.col(c).try_cast("int"), F.lit(0)) == 1
    n = df.agg(F.count("*").alias("n"), *[F.count(F.when(one(c), 1)).alias(f"c{i}") for i, (_, c) in enumerate(edges)], *[F.count(F.when(one(p), 1)).alias(f"p{i}") for i, (p, _) in enumerate(edges)], *[F.count(F.when(one(p) & one(c), 1)).alias(f"b{i}") for i, (p, c) in enumerate(edges)])
    rows = n.select("n", F.explode(F.array(*[F.struct(F.lit(p).alias("parent"), F.lit(c).alias("child"), F.col(f"c{i}").alias("c"), F.col(f"p{i}").alias("p"), F.col(f"b{i}").alias("b")) for i, (p, c) in enumerate(edges)])).alias("t")).select("n", "t.*")
    return rows.where("c > 0 and p > 0").select("parent", "child", (F.col("c") / F.col("n")).alias("p_child"), (F.col("b") / F.col("p")).alias("p_child_given_parent"), (F.col("b") / F.col("p") * F.col("n") / F.col("c")).alias("lift"))


def pattern_counts(df: DataFrame, nodes: list[str]) -> DataFrame:
    """(nodes..., n): the distinct rows of binary columns with their number; sufficient for every score."""
    return df.select(*[F.coalesce(F.col(c).try_cast("int"), F.lit(0)).alias(c) for c in nodes]).groupBy(*nodes).agg(F.count("*").alias("n"))


def bic(counts: np.ndarray, total: int, q: int) -> float:
    """BIC of one family; counts: rows parent states, columns node states."""
    s = counts.sum(1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        ll = np.where(counts > 0, counts * np.log(counts / s), 0.0).sum()
    return float(ll - 0.5 * math.log(max(total, 1)) * q)


def family_scores(df: DataFrame, families: list[tuple[str, tuple[str, ...]]]) -> DataFrame:
    """G3. (node, parents, bic) of stated families, each from one aggregation."""
    from ..session import cut

    spark, out = df.sparkSession, []
    held = cut(pattern_counts(df, sorted({c for node, ps in families for c in (node, *ps)})))
    for node, parents in families:
        rows = held.groupBy(*parents, node).agg(F.sum("n").alias("count")).collect()  # at most 2 ** (parents + 1) rows
        table = np.zeros((2 ** len(parents), 2))
        for r in rows:
            table[sum(int(r[p] == 1) << i for i, p in enumerate(parents)), int(r[node] == 1)] += r["count"]
        out.append((node, ",".join(parents), bic(table, int(table.sum()), 2 ** len(parents))))
    return spark.createDataFrame(out, "node string, parents string, bic double")


def hill_climb(df: DataFrame, nodes: list[str], banned: set[tuple[str, str]] = frozenset(), most_parents: int = 3, steps: int = 500) -> list[tuple[str, str]]:
    """G3, J14. Edges found by adding, dropping or turning the arc that raises the BIC most, without cycles or banned arcs.

    Spark counts pairs, triples and so on by need: the scores of all candidate families of a step come from one aggregation.
    """
    import pyspark.sql.functions as fn

    parents: dict[str, tuple[str, ...]] = {n: () for n in nodes}
    known: dict[tuple[str, tuple[str, ...]], float] = {}
    held = df.select(*[F.coalesce(F.col(c).try_cast("int"), F.lit(0)).alias(c) for c in nodes])
    from ..session import cut

    held = cut(held)

    def fetch(wanted: set[tuple[str, tuple[str, ...]]]) -> None:
        todo = sorted(w for w in wanted if w not in known)
        for k in range(0, len(todo), 40):
            part, cols = todo[k : k + 40], []
            for i, (node, ps) in enumerate(part):
                for s in range(2 ** (len(ps) + 1)):
                    hit = fn.lit(True)
                    for j, c in enumerate([*ps, node]):
                        hit &= fn.col(c) == (s >> j & 1)
                    cols.append(fn.count(fn.when(hit, 1)).alias(f"f{i}_{s}"))
            r = held.agg(*cols).first()
            for i, (node, ps) in enumerate(part):
                flat = np.array([r[f"f{i}_{s}"] for s in range(2 ** (len(ps) + 1))], float).reshape(2, -1).T
                known[node, ps] = bic(flat, int(flat.sum()), 2 ** len(ps))

    def reaches(a: str, b: str, without: tuple[str, str] | None = None) -> bool:
        stack, seen = [a], set()
        while stack:
            x = stack.pop()
            if x == b:
                return True
            if x not in seen:
                seen.add(x)
                stack += [c for c in nodes if x in parents[c] and (x, c) != without]
        return False

    for _ in range(steps):
        moves: list[tuple[dict[str, tuple[str, ...]], tuple]] = []
        for a, b in itertools.permutations(nodes, 2):
            if a in parents[b]:
                less = tuple(p for p in parents[b] if p != a)
                moves.append(({b: less}, ("drop", a, b)))
                if (b, a) not in banned and len(parents[a]) < most_parents and not reaches(a, b, (a, b)):
                    moves.append(({b: less, a: tuple(sorted((*parents[a], b)))}, ("turn", a, b)))
            elif b not in parents[a] and (a, b) not in banned and len(parents[b]) < most_parents and not reaches(b, a):
                moves.append(({b: tuple(sorted((*parents[b], a)))}, ("add", a, b)))
        fetch({(n, parents[n]) for n in nodes} | {(n, ps) for m, _ in moves for n, ps in m.items()})
        gain, best = 1e-9, None
        for m, name in moves:
            g = sum(known[n, ps] - known[n, parents[n]] for n, ps in m.items())
            if g > gain + 1e-12:
                gain, best = g, m
        if best is None:
            break
        parents.update(best)
    return sorted((p, n) for n in nodes for p in parents[n])


def acyclic(edges: list[tuple[str, str]]) -> bool:
    left = list(edges)
    while left:
        heads = {c for _, c in left}
        keep = [(p, c) for p, c in left if p in heads]
        if len(keep) == len(left):
            return False
        left = keep
    return True


def closing_edge(edges: list[tuple[str, str]]) -> tuple[str, str] | None:
    """The edge that closes the first cycle met when nodes and their children are followed in the order given."""
    after: dict[str, list[str]] = {}
    for p, c in edges:
        after.setdefault(p, []).append(c)
        after.setdefault(c, [])
    done: set[str] = set()
    for start in after:
        path, todo = [start], [iter(after[start])]
        while todo and start not in done:
            child = next(todo[-1], None)
            if child is None:
                done.add(path.pop())
                todo.pop()
            elif child in path:
                return path[-1], child
            elif child not in done:
                path.append(child)
                todo.append(iter(after[child]))
    return None


def break_cycles(edges: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """G4. Edges in order without the last edge of each cycle that is found, until there is none."""
    kept = list(dict.fromkeys(edges))
    while (e := closing_edge(kept)) is not None:
        kept.remove(e)
    return kept


def pruned(edges: list[tuple[str, str]], banned: set[tuple[str, str]]) -> list[tuple[str, str]]:
    """G4. Edges that aren't banned, in order."""
    return [e for e in edges if e not in banned]


def infer(tables: dict[str, tuple[list[str], np.ndarray]], variables: list[str], evidence: dict[str, int] | None = None) -> np.ndarray:
    """G7. P(variables | evidence) of a discrete network by variable elimination.

    tables: node -> (parents, probabilities with one axis a parent and the node's own last). The sum runs over one variable
    at a time, the one whose factors span the fewest others first. A network has tens of nodes, so this is driver work.
    """
    given = evidence or {}
    factors: list[tuple[tuple[str, ...], np.ndarray]] = []
    for node, (parents, p) in tables.items():
        names, values = [*parents, node], np.asarray(p, float)
        for name in [n for n in names if n in given]:
            values = np.take(values, given[name], axis=names.index(name))
            names.remove(name)
        factors.append((tuple(names), values))

    def product(some):
        names = sorted({n for ns, _ in some for n in ns})
        letter = {n: chr(97 + i) if i < 26 else chr(39 + i) for i, n in enumerate(names)}
        return tuple(names), np.einsum(",".join("".join(letter[n] for n in ns) for ns, _ in some) + "->" + "".join(letter.values()), *[v for _, v in some])

    hidden = {n for ns, _ in factors for n in ns} - set(variables)
    while hidden:
        width = {h: len({n for ns, _ in factors if h in ns for n in ns}) for h in hidden}
        h = min(hidden, key=lambda n: (width[n], n))
        mine = [f for f in factors if h in f[0]]
        names, values = product(mine)
        factors = [f for f in factors if h not in f[0]] + [(tuple(n for n in names if n != h), values.sum(names.index(h)))]
        hidden.remove(h)
    names, values = product(factors)
    values = np.transpose(values, [names.index(v) for v in variables])
    return values / values.sum()


def network_tables(df: DataFrame, parents: dict[str, list[str]], sample_size: float = 5.0) -> dict[str, tuple[list[str], np.ndarray]]:
    """The tables that `infer` takes, of binary nodes with these parents."""
    from ..session import cut

    held, out = cut(pattern_counts(df, sorted(parents)).withColumnRenamed("n", "_n")), {}
    for node, ps in parents.items():
        q, n = 2 ** len(ps), np.zeros([2] * (len(ps) + 1))
        for r in held.groupBy(*ps, node).agg(F.sum("_n").alias("_n")).collect():  # at most 2 ** (parents + 1) rows
            n[tuple(int(r[c] == 1) for c in [*ps, node])] += r["_n"]
        total = n.sum(-1, keepdims=True)
        if sample_size > 0:
            p = (n + sample_size / (2 * q)) / (total + sample_size / q)
        else:
            p = np.divide(n, total, out=np.full_like(n, 0.5), where=total > 0)
        out[node] = (list(ps), p)
    return out


def marginals(tables: dict[str, tuple[list[str], np.ndarray]], most: int = 12) -> list[tuple[str, int, float]]:
    """G7. (node, state, p) of the first nodes, the default queries."""
    return [(n, s, float(p)) for n in list(tables)[:most] for s, p in enumerate(infer(tables, [n]))]


def weak_components(nodes: list[str], edges: list[tuple[str, str]]) -> int:
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for p, c in edges:
        up[root(p)] = root(c)
    return len({root(n) for n in nodes})


def model_diagnostics(spark: SparkSession, name: str, nodes: list[str], edges: list[tuple[str, str]]) -> DataFrame:
    """G10. One row for a network, isolated nodes included."""
    e = list(dict.fromkeys(edges))
    into, touched = [c for _, c in e], [x for p in e for x in p]
    lone = [n for n in nodes if n not in touched]
    row = (name, len(nodes), len(e), acyclic(e), max((into.count(n) for n in nodes), default=0), len(touched) / max(1, len(nodes)), weak_components(nodes, e), len(lone), " | ".join(lone[:20]))
    return spark.createDataFrame([row], "model_name string, n_nodes int, n_edges int, acyclic boolean, max_indegree int, mean_degree double, n_weakly_connected int, n_isolated int, isolated_nodes string")


def structure_row(spark: SparkSession, name: str, ranks: dict[str, str], edges: list[tuple[str, str]]) -> DataFrame:
    """G10. One row for the comparison of structures; ranks: the macro of every node."""
    banned = {(r.parent, r.child) for r in forbidden(spark, ranks).collect()}
    e, n = list(dict.fromkeys(edges)), len(ranks)
    row = (name, len(e), n, sum(x in banned for x in e), len(e) / max(1, n * (n - 1)), len(set(ranks) - {x for p in e for x in p}))
    return spark.createDataFrame([row], "structure string, n_arcs int, n_nodes int, macro_order_violations int, density double, n_isolated int")


def diagnostics(edges: DataFrame) -> DataFrame:
    """G10. One row: n_nodes (of edges), n_edges, density, max_in_degree, max_out_degree, n_roots, n_leaves."""
    e = edges.select("parent", "child").distinct()
    ends = e.select(F.explode(F.array(F.struct(F.col("parent").alias("n"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("child").alias("n"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).select("x.*")
    deg = ends.groupBy("n").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    one = deg.agg(F.count("*").alias("n_nodes"), F.sum("i").alias("n_edges"), F.max("i").alias("max_in_degree"), F.max("o").alias("max_out_degree"), F.count(F.when(F.col("i") == 0, 1)).alias("n_roots"), F.count(F.when(F.col("o") == 0, 1)).alias("n_leaves"))
    return one.withColumn("density", F.try_divide(F.col("n_edges"), F.col("n_nodes") * (F.col("n_nodes") - 1)))


def violations(edges: DataFrame, banned: DataFrame) -> DataFrame:
    """J15. Edges that are forbidden."""
    return edges.join(banned, ["parent", "child"], "left_semi")


def adjacency(spark: SparkSession, nodes: list[str], edges: DataFrame) -> DataFrame:
    """G12. (parent, child, present) for all pairs of a network's nodes."""
    n = spark.createDataFrame([(x,) for x in nodes], "parent string")
    return n.crossJoin(n.withColumnRenamed("parent", "child")).join(edges.select("parent", "child").distinct().withColumn("present", F.lit(1)), ["parent", "child"], "left").fillna(0, ["present"])  # nodes of one network


def scenarios(matrix: DataFrame, variables: list[str], top: int = 10, least: int = 5) -> DataFrame:
    """G11, A34, A35, O2. (scenario, support, p_severity_high, macro_path): the most frequent sets of topics, the empty one
    included; of the 3 x top first by support (ties by name) those of least support, then the first top."""
    present = F.concat_ws("+", *[F.when(F.col(v) == 1, F.lit(v)) for v in sorted(variables)])
    g = matrix.groupBy(present.alias("scenario")).agg(F.count("*").alias("support"), F.avg("severity_high").alias("p_severity_high"))
    path = F.concat_ws(">", *[F.when(F.exists(F.split("scenario", r"\+"), lambda v: v.endswith(f"_{m}")), F.lit(m)) for m in MACROS])
    ranked = g.orderBy(F.desc("support"), "scenario").limit(3 * top).where(F.col("support") >= least).orderBy(F.desc("support"), "scenario").limit(top)
    return ranked.withColumn("macro_path", path)


def severe(table: DataFrame, top: int = 5) -> DataFrame:
    """O3. The scenarios of highest mean severity, ties by support and name."""
    return table.orderBy(F.desc("p_severity_high"), F.desc("support"), "scenario").limit(top)


def examples(matrix: DataFrame, variables: list[str], table: DataFrame, units: DataFrame, accidents: int = 5, sentences: int = 2) -> DataFrame:
    """J7, H18. (scenario, accident_id, doc_id, sentence): the first accidents of each scenario, their first sentences, 200 characters each."""
    present = F.concat_ws("+", *[F.when(F.col(v) == 1, F.lit(v)) for v in sorted(variables)])
    mine = matrix.select("accident_id", present.alias("scenario")).join(F.broadcast(table.select("scenario")), "scenario")  # top scenarios
    first = mine.withColumn("r", F.row_number().over(Window.partitionBy("scenario").orderBy("accident_id"))).where(F.col("r") <= accidents).drop("r")
    rows = units.where("sentence is not null").join(first, "accident_id")
    w = Window.partitionBy("scenario", "accident_id").orderBy("doc_id")
    return rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= sentences).select("scenario", "accident_id", "doc_id", F.left("sentence", F.lit(200)).alias("sentence"))
