"""Registered queries: learners (M1-M3, M9-M15, M4-M8). Their checks are
rows-only in the driver; the unit tests compare them with brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlab.functions.columns import AGE_BANDS, AGE_UNKNOWN
from reviewlab.operators.boost import (
    BoostParams, cross_validate, fit_boosted, importance, param_grid, predict_boosted,
    top_features,
)
from reviewlab.operators.metrics import class_metrics, confusion
from reviewlab.operators.sampling import split_exact
from reviewlab.operators.sentiment import review_sentiment
from reviewlab.operators.tree import fit_tree, predict_tree, tree_nodes
from reviewlab.operators.util import cut_lineage
from reviewlab.plans.q_features import VOCAB_SQL
from reviewlab.plans.queries import KEYS10, prepared, prepared_reviews
from reviewlab.plans.registry import query

TREE_FEATURES = ["age_div", "recommended", "devision", "class", "department"]
BOOST_FEATURES = ["recommended", "age", "age_div", "positive_feedback", "devision", "class",
                  "department", "sum_senta", "sum_sentb"]
#: age bands in their order, by which the boosted trees split them
AGE_ORDER = {"age_div": [label for _, _, label in AGE_BANDS] + [AGE_UNKNOWN]}


def _split(spark, sf):
    df = prepared_reviews(spark, sf)
    return split_exact(df, "v1", 0.8, seed=22)


def _tree(spark, sf):
    s = _split(spark, sf)
    return s, fit_tree(s.where("split = 'train'"), "rating", TREE_FEATURES, cp=0.001)


@query("tree_nodes")
def q_tree_nodes(spark, sf):
    _, m = _tree(spark, sf)
    return tree_nodes(m, spark)


#: levels of the tree that the twin grows, and the levels of a category up to which it tries all partitions
TWIN_DEPTH, TWIN_EXHAUSTIVE = 3, 10


def _levels_sql(depth: int = TWIN_DEPTH, exhaustive: int = TWIN_EXHAUSTIVE, cp: float = 0.001) -> str:
    """The unpruned tree of the first levels, level by level: all partitions of
    a category's levels (or cuts of their order by each class's share) with the
    Gini gain of each, and rows moved by the best one; a row without a value
    (an age between two bands) by the surrogates. A node is named by its way
    from the root, as in 1, 1L, 1LR."""
    values = ", ".join(f"cast({c} as varchar)" for c in TREE_FEATURES)
    per_class = lambda e: "[" + ", ".join(f"coalesce(sum(n) filter (where {e.format(k)}), 0)" for k in range(1, 6)) + "]"
    squares = lambda c: f"list_sum(list_transform({c}, lambda v: v * v * 1.0))"
    both = "list_transform(list_zip(cl, cr), lambda p: coalesce(p[1], 0) + coalesce(p[2], 0))"
    out = [f"""
, cut as (select *, row_number() over (order by md5('22-' || cast(v1 as varchar)), v1) <= ceil(0.8 * count(*) over ()) as train from complete)
, r0 as (select v1, '1' as node, rating as y, [{values}] as x from cut where train)
, root as (select {cp} * (count(*) - (select max(n) from (select count(*) as n from r0 group by y))) as floor_ from r0)"""]
    for d in range(depth + 1):
        out.append(f"""
, n{d} as (select node, sum(n) as n, {per_class("y = {}")} as c from (select node, y, count(*) as n from r{d} group by all) group by node)""")
        if d == depth:
            break
        out.append(f"""
, v{d} as (select node, f, lv, sum(n) as n, {per_class("y = {}")} as c
           from (select node, y, f, lv, count(*) as n
                 from (select node, y, unnest(range({len(TREE_FEATURES)})) as f, unnest(x) as lv from r{d}) where lv is not null group by all)
           group by node, f, lv)
, p{d} as (select v.*, row_number() over (partition by v.node, f order by lv) - 1 as pos, count(*) over (partition by v.node, f) as m
           from v{d} v join n{d} t using (node), root where t.n >= 20 and t.n - list_max(t.c) > floor_)
, o{d} as (select *, row_number() over (partition by node, f, k order by c[k + 1] / n, pos) - 1 as spot
           from (select *, unnest(range(5)) as k from p{d} where m > {exhaustive}))
, s{d} as (select node, f, ord, lv, n, c, pos, pos = 0 or (ord >> (pos - 1)) & 1 = 1 as is_left
           from (select *, unnest(range((1 << (m - 1)) - 1)) as ord from p{d} where m between 2 and {exhaustive})
           union all
           select node, f, k * 1000 + cut, lv, n, c, pos, spot <= cut from (select *, unnest(range(m - 1)) as cut from o{d}))
, g{d} as (select node, f, ord, sum(n) filter (where is_left) as nl, sum(n) filter (where not is_left) as nr,
                  {"[" + ", ".join(f"sum(c[{k}]) filter (where is_left)" for k in range(1, 6)) + "]"} as cl,
                  {"[" + ", ".join(f"sum(c[{k}]) filter (where not is_left)" for k in range(1, 6)) + "]"} as cr,
                  list(lv order by pos) filter (where is_left) as a, list(lv order by pos) filter (where not is_left) as b
           from s{d} group by node, f, ord)
, b{d} as (select node, f, gain, case when a[1] < b[1] then a else b end as lefts
           from (select g.node, f, a, b, gain, row_number() over (partition by g.node order by gain desc, f, ord) as rn
                 from (select g.*, round({squares("cl")} / nl + {squares("cr")} / nr - {squares(both)} / (nl + nr), 6) as gain
                       from g{d} g where nl >= 7 and nr >= 7) g where gain > 0) where rn = 1)
, w{d} as (select v1, node, f, y, x, case when x[f + 1] is null then null when list_contains(lefts, x[f + 1]) then 'L' else 'R' end as way
           from r{d} join b{d} using (node))
, t{d} as (select node, count(*) filter (where way = 'L') as wl, count(*) filter (where way = 'R') as wr from w{d} group by node)
, q{d} as (select node, g, lv, count(*) filter (where way = 'L') as cl, count(*) filter (where way = 'R') as cr
           from (select node, f, way, unnest(range({len(TREE_FEATURES)})) as g, unnest(x) as lv from w{d} where way is not null)
           where g <> f and lv is not null group by node, g, lv)
, k{d} as (select node, g, row_number() over (partition by node order by agree desc, g) as rank
           from (select node, g, sum(greatest(cl, cr)) + case when wr > wl then wr - sum(cr) else wl - sum(cl) end as agree, greatest(wl, wr) as most,
                        coalesce(sum(cl + cr) filter (where cl > cr), 0) as nl, coalesce(sum(cl + cr) filter (where cl <= cr), 0) as nr
                 from q{d} join t{d} using (node) group by node, g, wl, wr) where agree > most and nl >= 2 and nr >= 2
           qualify rank <= 5)
, m{d} as (select v1, min_by(case when cl > cr then 'L' else 'R' end, rank) as way
           from w{d} w join k{d} using (node) join q{d} q using (node, g) where w.way is null and q.lv = x[g + 1] group by v1)
, r{d + 1} as (select v1, node || coalesce(w.way, m.way, case when wr > wl then 'R' else 'L' end) as node, y, x
               from w{d} w join t{d} using (node) left join m{d} m using (v1))""")
    names = "[" + ", ".join(f"'{c}'" for c in TREE_FEATURES) + "]"
    rows = [f"select t.node, t.n, t.c, b.f, b.lefts, b.gain from n{d} t left join b{d} b using (node)" for d in range(depth)]
    rows.append(f"select node, n, c, null, null, null from n{depth}")
    out.append(f"""
select node, cast(n as bigint) as n, cast(n - list_max(c) as bigint) as loss, list_position(c, list_max(c)) as class,
       {names}[f + 1] as feature, array_to_string(lefts, ',') as lefts, gain
from ({" union all ".join(rows)})""")
    return "".join(out)


@query("tree_levels", sql=_levels_sql())
def q_tree_levels(spark, sf):
    """Every node of the first levels of the tree before pruning: rows, errors,
    class, split feature, its left levels and Gini gain."""
    s = _split(spark, sf).where("split = 'train'")
    m = fit_tree(s, "rating", TREE_FEATURES, cp=0.001, max_depth=TWIN_DEPTH, categorical=TREE_FEATURES, exhaustive=TWIN_EXHAUSTIVE)
    way, rows = {0: "1"}, []
    for n in m.nodes:
        feature = lefts = gain = None
        if n["leftChild"] >= 0:
            way[n["leftChild"]], way[n["rightChild"]] = way[n["id"]] + "L", way[n["id"]] + "R"
            r = n["rules"][0]
            feature, gain = TREE_FEATURES[r.feature], n["gain"]
            lefts = ",".join(m.binning.levels[feature][c] for c in r.left)
        rows.append((way[n["id"]], int(n["n"]), int(n["err"]), int(m.labels[n["cls"]]), feature, lefts, gain))
    return spark.createDataFrame(rows, "node string, n long, loss long, class int, feature string, lefts string, gain double")


@query("tree_predictions")
def q_tree_predictions(spark, sf):
    s, m = _tree(spark, sf)
    return predict_tree(m, s.where("split = 'test'"), keep=["v1", "rating"])


@query("tree_metrics")
def q_tree_metrics(spark, sf):
    p = q_tree_predictions(spark, sf)
    return class_metrics(confusion(p, "rating", "prediction", labels=[1, 2, 3, 4, 5]))


def _boost_input(spark, sf):
    df, lx = prepared(spark, sf)
    # read by the split, the binning and every round: the texts are read once
    s = cut_lineage(review_sentiment(df, lx.stop, lx.bing, lx.afinn, keys=KEYS10))
    return split_exact(s, "v1", 0.8, seed=22)


def _boosted(spark, sf, rounds=10):
    s = _boost_input(spark, sf)
    train, test = s.where("split = 'train'"), s.where("split = 'test'")
    m = fit_boosted(train, "rating", BOOST_FEATURES,
                    BoostParams(eta=0.1, max_depth=3, subsample=0.6, colsample_bytree=0.6),
                    rounds=rounds, num_class=6, watch=test, ordered=AGE_ORDER)
    return s, m


@query("boosted_predictions")
def q_boosted_predictions(spark, sf):
    s, m = _boosted(spark, sf)
    return predict_boosted(m, s.where("split = 'test'"), keep=["v1", "rating"])


@query("boosted_history")
def q_boosted_history(spark, sf):
    _, m = _boosted(spark, sf)
    return spark.createDataFrame(m.history, "round int, train_mlogloss double, test_mlogloss double")


@query("boosted_importance")
def q_boosted_importance(spark, sf):
    _, m = _boosted(spark, sf)
    return top_features(importance(m, spark), 8)


#: the scripts' grid (fixed values)
GRID = dict(eta=[0.02, 0.06, 0.1], max_depth=[2, 5, 10], subsample=[0.6], colsample_bytree=[0.6])
#: rounds at most, and without a better test loss, of the scripts with this grid
CV_ROUNDS, CV_PATIENCE = 1_000, 10


@query("boosted_cv")
def q_boosted_cv(spark, sf):
    """CV over the scripts' 3 x 3 grid with the scripts' rounds and patience,
    all grid rows in one series of jobs, each stopped early by itself."""
    s = _boost_input(spark, sf)
    return cross_validate(s.where("split = 'train'"), "rating", BOOST_FEATURES, param_grid(spark, **GRID),
                          rounds=CV_ROUNDS, k=5, patience=CV_PATIENCE, num_class=6, ordered=AGE_ORDER)


# --- M9: SMOTE ---------------------------------------------------------------

SMOTE_NUMERIC = ["age", "positive_feedback", "sum_senta", "sum_sentb"]
SMOTE_CATEGORICAL = ["recommended", "age_div", "devision", "class", "department"]


def _sentiment_rows(spark, sf):
    df, lx = prepared(spark, sf)
    return cut_lineage(review_sentiment(df, lx.stop, lx.bing, lx.afinn, keys=KEYS10))


SMOTE_SQL = f"""
, words as (select {", ".join(KEYS10)}, unnest(regexp_extract_all(lower(review_text), '[\\p{{L}}\\p{{N}}]+(?:\\x27[\\p{{L}}\\p{{N}}]+)*')) as word from complete)
, s2 as (
  select {", ".join(KEYS10)},
         sum(case when b.sentiment = 'positive' then 1 else -1 end) as sum_sentb, sum(a.score) as sum_senta
  from words w join bing b using (word) join afinn a using (word)
  where not exists (select 1 from stop_words s where s.word = w.word) 
  group by all)
, rg as (select rating, min(age) as l1, max(age) as h1, min(positive_feedback) as l2, max(positive_feedback) as h2,
                min(sum_senta) as l3, max(sum_senta) as h3, min(sum_sentb) as l4, max(sum_sentb) as h4
         from s2 where rating <= 4 group by rating)
, sc as (select s2.v1, s2.rating,
                (age - l1) / coalesce(nullif(cast(h1 - l1 as double), 0), 1.0) as x1,
                (positive_feedback - l2) / coalesce(nullif(cast(h2 - l2 as double), 0), 1.0) as x2,
                (sum_senta - l3) / coalesce(nullif(cast(h3 - l3 as double), 0), 1.0) as x3,
                (sum_sentb - l4) / coalesce(nullif(cast(h4 - l4 as double), 0), 1.0) as x4,
                {", ".join(SMOTE_CATEGORICAL)}
         from s2 join rg using (rating))
, pairs as (select a.rating, a.v1, b.v1 as nb_key,
                   sqrt((a.x1 - b.x1) * (a.x1 - b.x1) + (a.x2 - b.x2) * (a.x2 - b.x2)
                        + (a.x3 - b.x3) * (a.x3 - b.x3) + (a.x4 - b.x4) * (a.x4 - b.x4)
                        {" ".join(f"+ (a.{c} is distinct from b.{c})::int" for c in SMOTE_CATEGORICAL)}) as dist
            from sc a join sc b on a.rating = b.rating and a.v1 <> b.v1)
"""


@query("smote_neighbours", sql=SMOTE_SQL + """
select rating, v1, nb_key, cast(rk as int) as rank, round(dist, 6) as dist from (
  select *, row_number() over (partition by rating, v1 order by round(dist, 9), nb_key) as rk from pairs)
where rk <= 5
""")
def q_smote_neighbours(spark, sf):
    """Exact 5 nearest neighbours within each minority class (grid search;
    the DuckDB twin compares all pairs)."""
    from reviewlab.operators.balance import nearest_neighbours
    s = _sentiment_rows(spark, sf).where(F.col("rating").isin(1, 2, 3, 4))
    nb = nearest_neighbours(s, "v1", SMOTE_NUMERIC, k=5, by="rating", categorical=SMOTE_CATEGORICAL)
    return nb.join(s.select("v1", "rating"), "v1").select(
        "rating", "v1", "nb_key", "rank", F.round("dist", 6).alias("dist"))


def _unit_sql(salt: str) -> str:
    """SQL of ``unit_draw`` of the synthetic row's key."""
    return f"(cast(('0x' || substr(md5('22-{salt}-' || gkey), 1, 8)) as bigint) / 4294967296.0)"


SMOTE_ROWS_SQL = SMOTE_SQL + f"""
, nb as (select rating, v1, nb_key, row_number() over (partition by rating, v1 order by round(dist, 9), nb_key) as rk from pairs
         qualify rk <= 5)
, nn as (select v1, count(*) as nn from nb group by v1)
, draws as (select s2.*, nn.nn, c.copy, cast(s2.v1 as varchar) || '-' || cast(c.copy as varchar) as gkey
            from s2 join nn using (v1), (select unnest(range(1, 7)) as copy) c where rating <= 4)
, picked as (select d.*, nb.nb_key from draws d join nb on nb.v1 = d.v1
             and nb.rk = cast(('0x' || substr(md5('22-nb-' || gkey), 1, 8)) as bigint) % d.nn + 1)
, syn as (
  select -(copy * 1000000000000 + p.v1) - 1 as v1, p.rating,
         {", ".join(f"case when {_unit_sql('cat-' + c)} < 0.5 then o.{c} else p.{c} end as {c}" for c in SMOTE_CATEGORICAL)},
         {", ".join(f"cast(p.{c} as double) + {_unit_sql('gap')} * (cast(o.{c} as double) - cast(p.{c} as double)) as {c}" for c in SMOTE_NUMERIC)},
         'synthetic' as origin, p.rating as pair
  from picked p join s2 o on o.v1 = p.nb_key)
, want as (select pair, count(*) as want from syn group by pair)
, maj as (select s2.*, w.pair, r.r, w.want, count(*) over (partition by w.pair, r.r) as n_maj,
                 row_number() over (partition by w.pair, r.r order by md5(cast(22 + 1000 * r.r + w.pair as varchar) || '-' || cast(v1 as varchar)), v1) as k
          from s2, want w, (select unnest(range(0, 50)) as r) r where rating = 5)
select v1, rating, {", ".join(SMOTE_CATEGORICAL)}, {", ".join(f"round({c}, 6) as {c}" for c in SMOTE_NUMERIC)}, origin, pair from (
  select v1, rating, {", ".join(SMOTE_CATEGORICAL)}, {", ".join(f"cast({c} as double) as {c}" for c in SMOTE_NUMERIC)}, 'minority' as origin, rating as pair
  from s2 where rating <= 4
  union all select * from syn
  union all select v1, rating, {", ".join(SMOTE_CATEGORICAL)}, {", ".join(f"cast({c} as double) as {c}" for c in SMOTE_NUMERIC)}, 'majority', pair
  from maj where k <= want - r * n_maj) t
"""


@query("smote_rows", sql=SMOTE_ROWS_SQL)
def q_smote_rows(spark, sf):
    """Minority, synthetic and drawn majority rows for classes 1..4 against 5
    (600 % over, 100 % under, k = 5), stacked."""
    from reviewlab.operators.balance import oversample_pairs
    s = _sentiment_rows(spark, sf)
    out = oversample_pairs(s, "rating", (1, 2, 3, 4), 5, over=600, under=100, k=5,
                           numeric=SMOTE_NUMERIC, categorical=SMOTE_CATEGORICAL)
    return out.select(*[F.round(c, 6).alias(c) if c in SMOTE_NUMERIC else c for c in out.columns])


# --- M4-M8: the net on multi-hot words, and its stacked column ------------------

WIDTH = 10_000


def _net_inputs(spark, sf):
    """Reviews with text, split 80/20; vocabulary fitted on the training
    part only; each row as its 0-based word positions and 0-based label."""
    from reviewlab.operators.clean import non_blank
    from reviewlab.operators.text import multi_hot_indices, sequences, top_words, word_counts
    from reviewlab.sources.fixtures import reviews
    r = non_blank(reviews(spark, sf)).select("v1", "review_text", "rating")
    r = split_exact(r, "v1", 0.8, seed=22)
    vocab = top_words(word_counts(r.where("split = 'train'")), WIDTH)
    seq = sequences(r, vocab, carry=["split", "rating"])
    rows = seq.select("v1", "split", (F.col("rating") - 1).alias("label"), multi_hot_indices("seq", WIDTH).alias("idx"))
    return cut_lineage(rows)


#: validation rows, as in the script; a smaller table gives an eighth of its training rows
VALIDATION = 1_000
#: steps an epoch: batches of 512 at sf0.1, and the same number at any size
STEPS = 14


def _net(spark, sf, epochs=10, validation=VALIDATION):
    from reviewlab.operators.mlp import fit_mlp
    rows = _net_inputs(spark, sf)
    train = rows.where("split = 'train'")
    parts = split_exact(train, "v1", share=None, n=min(validation, train.count() // 8), seed=23, out="part",
                        first="val", second="fit")
    m = fit_mlp(parts.where("part = 'fit'"), "idx", "label", WIDTH, classes=5, epochs=epochs,
                steps_per_epoch=STEPS, validation=parts.where("part = 'val'"))
    return rows, m


@query("mlp_history")
def q_mlp_history(spark, sf):
    from reviewlab.operators.mlp import history_frame
    _, m = _net(spark, sf)
    return history_frame(spark, m)


@query("mlp_predictions")
def q_mlp_predictions(spark, sf):
    from reviewlab.functions.columns import argmax
    from reviewlab.operators.mlp import predict_mlp
    rows, m = _net(spark, sf)
    p = predict_mlp(m, rows.where("split = 'test'"), "idx", keep=["v1", "label"])
    return p.select("v1", (F.col("label") + 1).alias("rating"), argmax("prob").alias("prediction"))


@query("stacked_column")
def q_stacked_column(spark, sf):
    from reviewlab.operators.mlp import stack
    rows, m = _net(spark, sf)
    return stack(rows.where("split = 'train'"), rows.where("split = 'test'"), m, "idx")


def _given_net_sql(width: int = WIDTH, hidden: int = 16, classes: int = 5, seed: int = 22) -> str:
    """Forward pass of the net with the weights of ``md5_weights`` on the
    word positions of every review: hidden values, probabilities."""
    sizes = [width, hidden, hidden, classes]
    out = [VOCAB_SQL, """
, idx as (select distinct t.v1, v.idx - 1 as i from (select v1, unnest(ws) as word from tv) t join vocab10k v using (word))
, a0 as (select v1, i, 1.0 as a from idx)"""]
    for n, (a, b) in enumerate(zip(sizes[:-1], sizes[1:]), 1):
        act = "greatest(z, 0.0)" if n < 3 else "z"
        out.append(f"""
, w{n} as (select i, j, sqrt(6.0 / {a + b}) * (2 * cast('0x' || substr(md5('{seed}-{n}-' || i || '-' || j), 1, 8) as bigint) / 4294967296.0 - 1) as w
           from (select unnest(range(-1, {a})) as i), (select unnest(range({b})) as j))
, a{n} as (select v1, i, {act} as a
           from (select v1, j as i, w + coalesce(s, 0) as z
                 from (select v1, j, w from tv, w{n} where i = -1)
                 left join (select v1, j, sum(a * w) as s from a{n - 1} join w{n} using (i) group by v1, j) using (v1, j)))""")
    out.append("""
, p as (select v1, i as k, exp(a - max(a) over (partition by v1)) / sum(exp(a - top)) over (partition by v1) as p
        from (select *, max(a) over (partition by v1) as top from a3))
""")
    return "".join(out)


GRADIENT_SQL = """
, d3 as (select v1, k as i, p - cast(k = rating - 1 as int) as d from p join (select v1, rating from reviews) using (v1))
, d2 as (select v1, w.i, sum(d * w) * cast(any_value(h.a) > 0 as int) as d
         from d3 join w3 w on w.j = d3.i join a2 h using (v1) where h.i = w.i group by v1, w.i)
, d1 as (select v1, w.i, sum(d * w) * cast(any_value(h.a) > 0 as int) as d
         from d2 join w2 w on w.j = d2.i join a1 h using (v1) where h.i = w.i group by v1, w.i)
select layer, cast(i as int) as i, cast(j as int) as j, round(g, 6) + 0.0 as grad from (
  select 1 as layer, a.i, d.i as j, sum(a * d) as g from a0 a join d1 d using (v1) group by a.i, d.i
  union all select 1, -1, i, sum(d) from d1 group by i
  union all select 2, a.i, d.i, sum(a * d) from a1 a join d2 d using (v1) group by a.i, d.i
  union all select 2, -1, i, sum(d) from d2 group by i
  union all select 3, a.i, d.i, sum(a * d) from a2 a join d3 d using (v1) group by a.i, d.i
  union all select 3, -1, i, sum(d) from d3 group by i)
"""


def _given_net(spark, sf):
    """All reviews with text as word positions and label, and a net of md5 weights."""
    from reviewlab.operators.clean import non_blank
    from reviewlab.operators.mlp import MLPModel, md5_weights
    from reviewlab.operators.text import multi_hot_indices, sequences, top_words, word_counts
    from reviewlab.sources.fixtures import reviews
    r = non_blank(reviews(spark, sf)).select("v1", "review_text", (F.col("rating") - 1).alias("label"))
    vocab = top_words(word_counts(r), WIDTH)
    rows = sequences(r, vocab, carry=["label"]).select("v1", multi_hot_indices("seq", WIDTH).alias("idx"), "label")
    return cut_lineage(rows), MLPModel(WIDTH, (16, 16), 5, md5_weights(WIDTH), [])


@query("mlp_given_probabilities", sql=_given_net_sql() + "select v1, cast(k as int) as k, round(p, 6) as prob from p")
def q_mlp_given(spark, sf):
    """Class probabilities of every review by a net of given weights."""
    from reviewlab.operators.mlp import predict_mlp
    rows, m = _given_net(spark, sf)
    return predict_mlp(m, rows, "idx", keep=["v1"]).select("v1", F.posexplode("prob").alias("k", "prob")) \
        .select("v1", "k", F.round("prob", 6).alias("prob"))


@query("mlp_given_gradient", sql=_given_net_sql() + GRADIENT_SQL)
def q_mlp_gradient(spark, sf):
    """Gradient of that net's summed cross-entropy over all reviews, by
    parameter (a bias has i = -1; first-layer rows of words that occur)."""
    import numpy as np
    import pandas as pd
    from reviewlab.operators.mlp import summed_gradient
    rows, m = _given_net(spark, sf)
    g, at, parts = summed_gradient(rows, m.weights, "idx", "label"), 0, []
    for n, w in enumerate(m.weights):
        block = g[at:at + w.size].reshape(-1, w.shape[-1])
        at += w.size
        i, j = (x.ravel() for x in np.indices(block.shape))
        parts.append(pd.DataFrame({"layer": n // 2 + 1, "i": i if n % 2 == 0 else i - 1, "j": j, "grad": block.ravel()}))
    table = spark.createDataFrame(pd.concat(parts), "layer int, i int, j int, grad double")
    met = rows.select(F.explode("idx").alias("i")).distinct().select(F.lit(1).alias("layer"), F.col("i").cast("int").alias("i"))
    first = table.join(met, ["layer", "i"], "left_semi")
    return first.unionByName(table.where("layer > 1 or i < 0")).select("layer", "i", "j", (F.round("grad", 6) + F.lit(0.0)).alias("grad"))


# --- the three flows end to end -------------------------------------------------

#: boosting rounds of the registered flows (a cross-validation and a fit each), and rounds without a better test loss
FLOW_ROUNDS, FLOW_PATIENCE = 4, 2


def _flow_inputs(spark, sf):
    from reviewlab.sources.fixtures import lexicons, reviews
    r = reviews(spark, sf)
    return r, lexicons(spark, reviews_df=r)


@query("flow_polarity_bands")
def q_flow_a(spark, sf):
    """Flow A's boosted-tree metrics over the three rating bands."""
    from reviewlab.plans.flows import polarity_three_bands
    r, lx = _flow_inputs(spark, sf)
    return polarity_three_bands(spark, r, lx, rounds=FLOW_ROUNDS, patience=FLOW_PATIENCE)["boosted_metrics"]


@query("flow_rebalanced_f1")
def q_flow_b(spark, sf):
    """Flow B's F1 per class, pruned tree next to boosted trees."""
    from reviewlab.plans.flows import rebalanced_five_classes
    r, lx = _flow_inputs(spark, sf)
    return rebalanced_five_classes(spark, r, lx, rounds=FLOW_ROUNDS, patience=FLOW_PATIENCE)["f1"]


@query("flow_stacked_f1")
def q_flow_c(spark, sf):
    """Flow C's F1 per class with the net's column among the features."""
    from reviewlab.plans.flows import stacked
    r, lx = _flow_inputs(spark, sf)
    rows, m = _net(spark, sf)
    return stacked(spark, r, lx, rows, m, rounds=FLOW_ROUNDS, patience=FLOW_PATIENCE)["f1"]


@query("boost_root_histogram", sql="""
, cnt as (
  select 'devision' as feature, devision as level, rating, count(*) as n from complete group by all
  union all select 'class', class, rating, count(*) from complete group by all
  union all select 'department', department, rating, count(*) from complete group by all)
, ks as (select unnest(range(0, 6)) as k)
select cast(k as int) as class_index, feature, level,
       round(sum(n) / 6.0 - sum(case when rating = k then n else 0 end), 6) as G,
       round(sum(n) * (2 * (cast(1 as double) / 6) * (cast(5 as double) / 6)), 6) as H
from cnt, ks group by all
""")
def q_boost_root_histogram(spark, sf):
    """Round 1, level 0 of the softmax boosting: gradient sums per class,
    feature and level (6 classes, as the workload sets)."""
    from reviewlab.operators.boost import root_histogram
    df = prepared_reviews(spark, sf)
    h = root_histogram(df, "rating", ["devision", "class", "department"], num_class=6)
    return h.select("class_index", "feature", "level", F.round("G", 6).alias("G"),
                    F.round("H", 6).alias("H"))


ROUND1 = ["devision", "class", "department"]
ROUND1_SQL = """
, cells as (
  select f, feature, level, rating from complete, (select unnest([0, 1, 2]) as f, unnest(['devision', 'class', 'department']) as feature) x,
         lateral (select case f when 0 then devision when 1 then class else department end as level) y)
, ks as (select unnest(range(0, 6)) as k)
, hist as (select k, f, feature, level, count(*) / 6.0 - count(*) filter (where rating = k) as g,
                  count(*) * (2 * (cast(1 as double) / 6) * (cast(5 as double) / 6)) as h
           from cells, ks group by all)
, sums as (select *, sum(g) over (partition by k, f) as gt, sum(h) over (partition by k, f) as ht from hist)
, gains as (select *, 0.5 * (g * g / (h + 1) + (gt - g) * (gt - g) / (ht - h + 1) - gt * gt / (ht + 1)) as gain
            from sums where h >= 1 and ht - h >= 1)
, best as (select * from gains where gain > 1e-12
           qualify row_number() over (partition by k order by round(gain, 9) desc, f, level) = 1)
"""


def _round1(spark, sf):
    df = prepared_reviews(spark, sf)
    return df, fit_boosted(df, "rating", ROUND1, BoostParams(eta=0.3, max_depth=1), rounds=1, num_class=6)


@query("boost_round1", sql=ROUND1_SQL + """
select cast(k as int) as class_index, feature, level, round(gain, 6) as gain, round(ht, 6) as cover,
       round(-0.3 * g / (h + 1), 6) as left_weight, round(-0.3 * (gt - g) / (ht - h + 1), 6) as right_weight from best
""")
def q_boost_round1(spark, sf):
    """The first round's trees of depth 1: split, gain and leaves per class."""
    _, m = _round1(spark, sf)
    rows = []
    for _, k, splits, leaves in m.trees:
        for f, b, gain, cover in splits.values():
            name = m.binning.features[f]
            rows.append((k, name, m.binning.levels[name][b], gain, cover, leaves.get(1), leaves.get(2)))
    out = spark.createDataFrame(rows, "class_index int, feature string, level string, gain double, cover double, "
                                      "left_weight double, right_weight double")
    return out.select("class_index", "feature", "level", *[F.round(c, 6).alias(c) for c in out.columns[3:]])


@query("boost_round1_predictions", sql=ROUND1_SQL + """
, votes as (select c.v1, b.k, round(case when (case f when 0 then devision when 1 then class else department end) = level
                                    then -0.3 * g / (h + 1) else -0.3 * (gt - g) / (ht - h + 1) end, 9) as w
            from complete c, best b)
select v1, cast(k as int) as prediction from votes
qualify row_number() over (partition by v1 order by w desc, k) = 1
""")
def q_boost_round1_predictions(spark, sf):
    """Class of each review by the first round's trees."""
    df, m = _round1(spark, sf)
    return predict_boosted(m, df, keep=["v1"])


@query("boost_round1_importance", sql=ROUND1_SQL + """
select feature, round(sum(gain) / (select sum(gain) from best), 6) as gain,
       round(sum(ht) / (select sum(ht) from best), 6) as cover,
       round(count(*) / (select count(*) from best), 6) as frequency from best group by feature
""")
def q_boost_round1_importance(spark, sf):
    _, m = _round1(spark, sf)
    imp = importance(m, spark)
    return imp.select("feature", *[F.round(c, 6).alias(c) for c in ("gain", "cover", "frequency")])


# --- the first round with numbers, an ordered and free categories, depth 2 -------

MIXED = ["age", "positive_feedback", "age_div", "devision", "class", "department"]


def _level_sql(n: int) -> str:
    """Histogram and best splits of the nodes of a level, from the rows'
    nodes, and the rows' nodes in the next one."""
    return f"""
, hist{n} as (select k, node, f, iscat, ord, lvl, sum(g) as g, sum(h) as h from at{n} join cells using (v1) group by all)
, sums{n} as (select *, sum(g) over w as gt, sum(h) over w as ht, max(ord) over w as most,
                case when iscat then g else sum(g) over (w order by ord) end as gl,
                case when iscat then h else sum(h) over (w order by ord) end as hl
              from hist{n} window w as (partition by k, node, f))
, gains{n} as (select *, 0.5 * (gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) - gt * gt / (ht + 1)) as gain
               from sums{n} where hl >= 1 and ht - hl >= 1 and (iscat or ord < most))
, best{n} as (select * from gains{n} where gain > 1e-12
              qualify row_number() over (partition by k, node order by round(gain, 9) desc, f, ord, lvl) = 1)
, at{n + 1} as (select a.v1, a.k, a.g, a.h, 2 * a.node + case when (case when b.iscat then c.lvl = b.lvl else c.ord <= b.ord end) then 1 else 2 end as node
              from at{n} a join best{n} b using (k, node) join cells c on c.v1 = a.v1 and c.f = b.f)"""


MIXED_SQL = f"""
, cells as (
  select v1, f, f >= 3 as iscat, case f when 0 then age when 1 then positive_feedback when 2 then coalesce(list_position({AGE_ORDER["age_div"]}, age_div), 0) - 1 else 0 end as ord,
         case f when 0 then cast(age as varchar) when 1 then cast(positive_feedback as varchar) when 2 then age_div
                when 3 then devision when 4 then class else department end as lvl
  from complete, (select unnest(range(0, 6)) as f))
, at0 as (select v1, k, 0 as node, cast(1 as double) / 6 - cast(rating = k as int) as g, 2 * (cast(1 as double) / 6) * (cast(5 as double) / 6) as h
          from complete, (select unnest(range(0, 6)) as k))
{_level_sql(0)}{_level_sql(1)}
, last as (select v1, k, node, g, h from at0 where k not in (select k from best0)
           union all select v1, k, node, g, h from at1 where (k, node) not in (select (k, node) from best1)
           union all select v1, k, node, g, h from at2)
, leaves as (select k, node, -0.3 * sum(g) / (sum(h) + 1) as weight from last group by all)
"""


def _mixed_round1(spark, sf):
    df = prepared_reviews(spark, sf)
    return df, fit_boosted(df, "rating", MIXED, BoostParams(eta=0.3, max_depth=2), rounds=1, num_class=6, bins=128, ordered=AGE_ORDER)


@query("boost_round1_mixed", sql=MIXED_SQL + """
select cast(k as int) as class_index, cast(node as int) as node, list_element(['age', 'positive_feedback', 'age_div', 'devision', 'class', 'department'], f + 1) as feature,
       lvl as split_at, round(gain, 6) as gain, round(ht, 6) as cover, cast(null as double) as weight
from (select * from best0 union all select * from best1) t
union all select cast(k as int), cast(node as int), null, null, null, null, round(weight, 6) from leaves
""")
def q_boost_round1_mixed(spark, sf):
    """The first round's trees of depth 2 over numbers, an ordered and free
    categories: splits and leaves."""
    _, m = _mixed_round1(spark, sf)
    rows = []
    for _, k, splits, leaves in m.trees:
        for node, (f, b, gain, cover) in splits.items():
            name = m.binning.features[f]
            values = m.binning.levels.get(name) or m.binning.ordered.get(name) or [f"{t:g}" for t in m.binning.thresholds[name]]
            rows.append((k, node, name, values[b] if b >= 0 else None, gain, cover, None))
        rows += [(k, node, None, None, None, None, w) for node, w in leaves.items()]
    out = spark.createDataFrame(rows, "class_index int, node int, feature string, split_at string, gain double, cover double, weight double")
    return out.select(*out.columns[:4], *[F.round(c, 6).alias(c) for c in out.columns[4:]])


@query("boost_round1_mixed_predictions", sql=MIXED_SQL + """
select v1, cast(k as int) as prediction from last join leaves using (k, node)
qualify row_number() over (partition by v1 order by round(weight, 9) desc, k) = 1
""")
def q_boost_round1_mixed_predictions(spark, sf):
    """Class of each review by those trees."""
    df, m = _mixed_round1(spark, sf)
    return predict_boosted(m, df, keep=["v1"])
