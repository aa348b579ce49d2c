"""One query per operator of the survey's inventory, bound to the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import baselines, cascade, community, evaluate, knn, labelling, profile, propagate, rules, sampling, vectors, weights
from ..session import cut, drop_later, forget, shared_dir
from ..sources import readers
from ..streaming import events as ev
from . import clustering

CATEGORIES = ["art_design", "business", "coding", "education", "finance", "health", "music", "science"]
SIGMA = 0.25

HEADS = ["Category: ", "- \"", "I would say ", "\u2022 ", ""]
SPELLINGS = ["Art-Design", "economics", "FINANCE", "coding", "Health", "none of them", "music", "science/"]
TAILS = ["\n", "\"\nbecause ", " ", "."]
#: Concepts that meet each rule of the filters.
CASES = ["ab", "3.14", "james", "james bond", "james mary", "james testing", "james pushkinovich", "please help", "sure thing", "scalable design", "value", "london", "wizard", "machine learning", " Trim Me "]
ANSWERS = ["Category: Art-Design", "- \"Finance\"", "economics", "I would say music", "coding\nbecause", "", "nothing known", "• Health"]
VERDICTS = ["ACCEPT", "REJECT\nbetter: music", "Borderline case", "This is wrong\nshould be coding", "correct", "no idea"]
JSONS = ['```json\n{"alpha": "science", "beta": "music",}\n```', 'Here: {"gamma": "coding"} ok', '"delta": "finance"\n"eps": "health"', "nothing"]


def _items(s: SparkSession, d: str) -> DataFrame:
    return readers.items(readers.table(s, d, "conversations"))


def _weights(s, d, **kw):
    items = cut(_items(s, d), "items")
    n = items.count()
    return items, n, cut(weights.concept_weights(items, n, **kw), "weights")


def _dense(s, d):
    return readers.vectors(readers.table(s, d, "embeddings"))


def _truth(s, d):
    return readers.table(s, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("label").cast("string").alias("label"))


def _knn(s, d, k=30):
    return cut(knn.knn_dense(_dense(s, d), k), "knn")


def _edges(s, d, sigma=SIGMA, k=10):
    return cut(knn.edges(_knn(s, d, k), sigma), "edges")


def _start(s, d):
    """A fixed labelling: the true label for one row in three, singletons else."""
    return readers.table(s, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.when(F.col("vec_id") % 3 == 0, F.col("label")).otherwise(F.col("vec_id") + 100).cast("long").alias("cluster_id"))


def _labels(s, d):
    return readers.table(s, d, "embeddings").select(F.col("vec_id").alias("item_id"), (F.col("vec_id") % 7).alias("cluster_id"))


def _long(s, d):
    return vectors.long_form(_dense(s, d))


def _literals(s, values, name):
    return s.createDataFrame(list(enumerate(values)), f"id long, {name} string")


def _turns(s, d):
    """(id, text) of every turn: what raw answers are made of."""
    c = readers.table(s, d, "conversations")
    ident = F.col("conv_id") * 100_000 + F.col("turn")
    return c.select(ident.alias("id"), F.coalesce("text", F.lit("")).alias("text"))


def _pick(values, by):
    return F.element_at(F.array(*map(F.lit, values)), (by + 1).cast("int"))


def _answers(s, d):
    """A raw answer a turn: every heading, name and tail in turn, then the turn's text."""
    i = F.col("id")
    parts = [_pick(HEADS, i % len(HEADS)), _pick(SPELLINGS, F.floor(i / 3) % len(SPELLINGS)), _pick(TAILS, F.floor(i / 7) % len(TAILS)), F.col("text")]
    return _turns(s, d).select("id", F.concat(*parts).alias("answer")).unionByName(_literals(s, ANSWERS, "answer").withColumn("id", -1 - F.col("id")))


def items_build(s, d):
    return _items(s, d).select("item_id", "conv_id", "turn", F.length("prompt").alias("prompt_chars"), F.length("response").alias("response_chars"))


def concept_drop_reason(s, d):
    terms = vectors.ngrams(_items(s, d)).select(F.col("term").alias("concept"))
    c = terms.unionByName(_literals(s, CASES, "concept").select("concept")).distinct()
    side = c.withColumn("is_prompt", F.explode(F.array(F.lit(True), F.lit(False))))
    return side.select("concept", "is_prompt", tx.drop_reason(F.col("concept"), F.col("is_prompt")).alias("relaxed"), tx.drop_reason_strict(F.col("concept"), F.col("is_prompt")).alias("strict"))


def drop_reason_counts(s, d):
    return weights.drop_reason_counts(weights.item_concepts(_items(s, d)))


def prompt_words(s, d):
    return _items(s, d).select("item_id", F.array_join(tx.prompt_words(F.col("prompt")), " ").alias("words"))


def concept_df_idf(s, d):
    items = _items(s, d)
    return weights.df_idf(weights.filtered(weights.item_concepts(items)), items.count()).select("concept", "df", F.round("idf", 6).alias("idf"))


def concept_weights(s, d):
    return _weights(s, d)[2]


def ppmi_prompt_response(s, d):
    items = cut(_items(s, d), "items")
    ic = weights.filtered(weights.item_concepts(items), strict=True)
    return weights.ppmi(items, ic, items.count(), min_joint=3).select("word", "concept", "joint", F.round("ppmi", 6).alias("ppmi"))


def concept_weights_strict(s, d):
    items = cut(_items(s, d), "items")
    return weights.concept_weights_strict(items, items.count(), min_df=3)


def conv_donor(s, d):
    items, _, w = _weights(s, d)
    return propagate.donors(w, items)


def conv_propagate(s, d):
    items, _, w = _weights(s, d, max_df_pct=0.02)
    return propagate.propagate(w, items)


def cooccurrence(s, d):
    return propagate.cooccurrence(_weights(s, d)[2]).where("n >= 2")


def pmi_topk(s, d):
    _, n, w = _weights(s, d)
    return propagate.associates(w, n).select("concept", "associate", F.round("pmi", 6).alias("pmi"), "rank")


def pmi_densify(s, d):
    _, n, w = _weights(s, d)
    return propagate.densify(w, n)


def pmi_ablation(s, d):
    _, n, w = _weights(s, d)
    return propagate.densify_ablation(w, n)


def concept_vectors_l2(s, d):
    return vectors.concept_vectors(_weights(s, d)[2]).select("item_id", "dim", F.round("v", 6).alias("v"))


def tfidf_vectors(s, d):
    items = cut(_items(s, d), "items")
    return vectors.tfidf(items, items.count()).select("item_id", "dim", F.round("v", 6).alias("v"))


def bow_counts(s, d):
    items = cut(_items(s, d), "items")
    return vectors.bag_of_words(items, items.count())


def _hybrid(s, d):
    items, n, w = _weights(s, d)
    return cut(vectors.hybrid(vectors.concept_vectors(w), vectors.tfidf(items, n)), "hybrid")


def hybrid_vectors(s, d):
    return _hybrid(s, d).select("item_id", "dim", F.round("v", 6).alias("v"))


def knn_dense(s, d):
    return _knn(s, d).select("i", "j", F.round("sim", 6).alias("sim"), "rank")


def knn_sparse(s, d):
    v = vectors.concept_vectors(_weights(s, d)[2])
    v = v.withColumn("v", F.round("v", 6))
    k = knn.knn_sparse(v, 10).select("i", "j", F.round("sim", 6).alias("sim"))
    return k.groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("sim"), 3).alias("total"), F.round(F.max("sim"), 5).alias("best"))


def knn_edges(s, d):
    return _edges(s, d).select("src", "dst", F.round("weight", 6).alias("weight"))


def knn_min_shared(s, d):
    items, _, w = _weights(s, d)
    forget(items)
    e = knn.similar_pairs(vectors.concept_vectors(w), 0.05, shared=2)
    return e.select(F.col("i").alias("src"), F.col("j").alias("dst"), "shared", F.round("sim", 5).alias("weight"))


def isolated_nodes(s, d):
    return knn.isolated(_dense(s, d), _edges(s, d, 0.33))


def graph_degrees(s, d):
    return knn.degrees(_edges(s, d)).select("item_id", "degree", F.round("strength", 5).alias("strength"))


def components(s, d):
    return community.components(_dense(s, d), _edges(s, d, 0.3))


def label_propagation(s, d):
    return community.label_propagation(_dense(s, d), _edges(s, d), 3)


def modularity_of_labels(s, d):
    return community.modularity(_edges(s, d), _labels(s, d), 1.0)


def leiden(s, d):
    return community.leiden(_dense(s, d), _edges(s, d), 1.0)


def centroids(s, d):
    return cascade.centroids(_long(s, d), _labels(s, d)).select("cluster_id", "dim", F.round("v", 6).alias("v"))


def assign_singletons(s, d):
    return cascade.assign_singletons(_long(s, d), _start(s, d), 0.15)


def cascade_labels(s, d):
    return cascade.cascade(_long(s, d), _start(s, d))


def cascade_rounds(s, d):
    return cascade.cascade_rounds(_long(s, d), _start(s, d))


def cluster_metrics(s, d):
    return evaluate.cluster_metrics(_start(s, d))


def nmi_ari(s, d):
    return evaluate.nmi_ari(_labels(s, d), _truth(s, d))


def balanced_score(s, d):
    return evaluate.balanced(_start(s, d), _truth(s, d))


def nmi_subset(s, d):
    shared = _truth(s, d).where("item_id % 5 = 0")
    return evaluate.nmi_ari(_labels(s, d), shared, 20)


def purity(s, d):
    return evaluate.purity(_labels(s, d), _truth(s, d))


def _raters(s, d):
    return readers.table(s, d, "labels").select(F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b"))


def kappa(s, d):
    return evaluate.kappa(_raters(s, d))


def kappa_bootstrap(s, d):
    return evaluate.kappa_bootstrap(_raters(s, d), 200)


def confusion(s, d):
    return evaluate.confusion(_raters(s, d))


def _scores(s, d):
    q = readers.table(s, d, "documents").groupBy("source").agg(F.avg(F.length("text")).alias("x"), F.avg(F.size(F.split("text", "\n")).cast("double")).alias("y"), F.min("lang").alias("type"))
    return q.select(F.col("source").alias("method"), "x", "y", F.when(F.substring("source", -1, 1).isin("0", "2", "4", "6", "8"), "even").otherwise("odd").alias("type"))


def kendall_tau(s, d):
    return evaluate.kendall_tau(_scores(s, d))


def bias_ratio(s, d):
    return evaluate.bias(_scores(s, d))


def neighbor_entropy(s, d):
    return evaluate.neighbour_entropy(_knn(s, d, 20), _labels(s, d))


def uncertain_anchors(s, d):
    return sampling.uncertain(evaluate.neighbour_entropy(_knn(s, d, 20), _labels(s, d))).select("item_id")


def _item_labels(s, d):
    return _items(s, d).select("item_id", (F.col("conv_id") % 5).alias("cluster_id"))


def cluster_profile_concepts(s, d):
    return profile.concept_scores(_item_labels(s, d), _weights(s, d)[2])


def cluster_profile_labels(s, d):
    return profile.label_shares(_labels(s, d), _truth(s, d))


def cluster_profiles(s, d):
    items, _, w = _weights(s, d)
    return profile.slim(profile.profiles(_item_labels(s, d), w, items))


def cluster_size_summary(s, d):
    return profile.size_summary(_start(s, d))


def _concept_labels(s, d):
    w = _weights(s, d)[2]
    first = F.substring("concept", 1, 1)
    return w, w.select("concept").distinct().select("concept", F.when(first < "m", F.concat(F.lit("a:"), first)).when(first < "x", F.concat(F.lit("m:"), first)).otherwise("unknown").alias("label"))


def gt_propagate(s, d):
    w, c = _concept_labels(s, d)
    return labelling.propagate_labels(w, c)


def category_merge(s, d):
    return labelling.merge_categories(_concept_labels(s, d)[1], 6)


def concept_frequency(s, d):
    return labelling.concept_frequency(_weights(s, d)[2])


def label_batches(s, d):
    w = _weights(s, d)[2].groupBy("concept").agg(F.count(F.lit(1)).alias("n"))
    return sampling.batches(w, "concept", "n", 50)


def rule_labels(s, d):
    return _weights(s, d)[2].select("concept").distinct().select("concept", labelling.rule_label("concept", CATEGORIES).alias("label"))


def label_kept(s, d):
    w = _weights(s, d)[2].select("concept").distinct()
    path = f"{shared_dir(s)}/topicloom/answers-{uuid.uuid4().hex}"
    drop_later(s, path)
    half = w.where(F.length("concept") % 2 == 0)
    ask = labelling.retrying(labelling.rule_labeller(CATEGORIES))
    labelling.label_kept(half.withColumn("value", F.col("concept")), "concept", "value", ask, CATEGORIES, path)
    return labelling.label_kept(w.withColumn("value", F.col("concept")), "concept", "value", ask, CATEGORIES, path, steps=2)


def label_dry_run(s, d):
    return labelling.dry_run(_weights(s, d)[2], "concept")


def _claims(s, d):
    """Each concept with a claimed category: its rule's, but for concepts that begin with a vowel."""
    c = _weights(s, d)[2].select("concept").distinct()
    return c.select("concept", F.when(F.col("concept").rlike("^[aeiou]"), "science").otherwise(labelling.rule_label("concept", CATEGORIES)).alias("label"))


def judge_verdicts(s, d):
    c = _claims(s, d).withColumn("text", F.col("concept"))
    return labelling.verify(c, "concept", "text", labelling.rule_judge(CATEGORIES), CATEGORIES)


def judge_agreement(s, d):
    c = _claims(s, d)
    return evaluate.kappa(labelling.classify(c.withColumn("text", F.col("concept")), "concept", "text", labelling.rule_labeller(CATEGORIES), CATEGORIES, c))


def label_normalize(s, d):
    return _answers(s, d).select("id", tx.normalise_label(F.col("answer"), CATEGORIES, {"economics": "finance"}).alias("label"))


def verdict_parse(s, d):
    v, better = tx.parse_verdict(F.col("answer"), CATEGORIES)
    i = F.col("id")
    said = _turns(s, d).select("id", F.concat(_pick(VERDICTS, i % len(VERDICTS)), F.lit(" "), _pick(SPELLINGS, F.floor(i / 3) % len(SPELLINGS)), F.lit("\n"), "text").alias("answer"))
    return said.unionByName(_literals(s, VERDICTS, "answer").withColumn("id", -1 - F.col("id"))).select("id", v.alias("verdict"), better.alias("better"))


def verdict_stats(s, d):
    v = readers.table(s, d, "labels").select(F.when(F.col("toxic") == 1, "reject").when(F.col("quality") == 1, "accept").otherwise("borderline").alias("verdict"))
    return evaluate.verdict_stats(v)


def json_label_parse(s, d):
    e = readers.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("k"), _pick(CATEGORIES, F.col("vec_id") % len(CATEGORIES)).alias("v"))
    fenced = F.concat(F.lit('```json\n{"'), "k", F.lit('": "'), "v", F.lit('", "also": "music",}\n```'))
    lines = F.concat(F.lit('Labels:\n"'), "k", F.lit('": "'), "v", F.lit('"\n"also" : "music"'))
    said = e.select("id", F.when(F.col("id") % 2 == 0, fenced).otherwise(lines).alias("answer"))
    return said.unionByName(_literals(s, JSONS, "answer").withColumn("id", -1 - F.col("id"))).select("id", F.explode(tx.json_labels(F.col("answer"))).alias("concept", "label"))


def ground_truth_layouts(s, d):
    e = readers.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("l"), F.col("label").cast("string")).alias("l")).where("l is not null")
    q = lambda name: F.concat(F.lit(f'"{name}": "'), F.col("id").cast("string"), F.lit('"'))
    pair = F.concat(F.lit('"'), F.col("id").cast("string"), F.lit('": "'), "l", F.lit('"'))
    row = lambda i, c: F.concat(F.lit("{"), q(i), F.lit(f', "{c}": "'), "l", F.lit('"}'))
    layout, joined = F.col("file") % 4, lambda x: F.array_join(F.collect_list(x), ", ")
    files = e.groupBy(F.floor(F.col("id") / 100).alias("file")).agg(joined(pair).alias("pairs"), joined(row("query_idx", "category")).alias("items"), joined(row("idx", "label")).alias("data"))
    around = lambda a, c, b: F.concat(F.lit(a), c, F.lit(b))
    doc = F.when(layout == 0, around('{"prompt_labels": {"x": "y", ', "pairs", "}}")).when(layout == 1, around('{"items": [', "items", "]}")).when(layout == 2, around('{"data": [', "data", "]}"))
    return readers.parse_ground_truth(files.select(doc.otherwise(around('{"note": "n", ', "pairs", "}")).alias("value")))


def stratified_sample(s, d):
    return sampling.stratified(readers.table(s, d, "documents").select("doc_id", "lang"), "doc_id", "lang", 50)


def capped_sample(s, d):
    return sampling.capped(readers.table(s, d, "documents").select("doc_id", "source"), "doc_id", "source", 70)


def uniform_sample(s, d):
    return sampling.uniform(readers.table(s, d, "documents").select("doc_id", "lang"), "doc_id", 25)


def triplets(s, d):
    return sampling.triplets(_labels(s, d), _dense(s, d))


def _runs(s, d):
    e = readers.table(s, d, "embeddings")
    one = lambda n, c: e.select(F.lit(n).alias("run"), F.col("vec_id").alias("item_id"), c.cast("long").alias("cluster_id"))
    return one("a", F.col("label")).unionByName(one("b", F.col("vec_id") % 4)).unionByName(one("c", F.col("vec_id") % 6))


def coassociation_edges(s, d):
    return community.coassociation(_knn(s, d, 10), _runs(s, d)).select("src", "dst", F.round("weight", 6).alias("weight"))


def ensemble_cluster(s, d):
    return community.ensemble(_dense(s, d), _knn(s, d, 10), _runs(s, d), 1.0)


def sweep_grid(s, d):
    return clustering.sweep(_dense(s, d), _truth(s, d), (0.2, 0.25), (1.0, 5.0), 10)[0]


def _results(s, d):
    r = readers.table(s, d, "orders").select(F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("run"), F.col("o_orderpriority").alias("family"), F.col("o_orderstatus").alias("algorithm"), F.round("o_totalprice", 2).alias("bal"))
    return r


def best_per_family(s, d):
    return clustering.best_per_family(_results(s, d))


def top_results(s, d):
    return _results(s, d).orderBy(F.desc("bal"), "run").limit(30).select("run", "bal")


def ablation_matrix(s, d):
    return clustering.ablation_matrix(_results(s, d).withColumnRenamed("family", "representation"), ["F", "O", "P"])


def concept_pipeline(s, d):
    return clustering.concept_clusters(_items(s, d), sigma=0.3, gamma=5.0)


def dense_pipeline(s, d):
    return clustering.dense_clusters(_dense(s, d), sigma=SIGMA, gamma=2.0, neighbours=10)


def kmeans_dense(s, d):
    return baselines.kmeans(_dense(s, d), 10)


def spherical_kmeans(s, d):
    return baselines.kmeans(_dense(s, d), 10, cosine=True)


def pca_kmeans(s, d):
    return baselines.kmeans(baselines.reduce_pca(_dense(s, d), 16), 10)


def lda_topics(s, d):
    return baselines.lda(_items(s, d), 8, iterations=5)


def nmf_als(s, d):
    items = cut(_items(s, d), "items")
    return baselines.nmf(cut(vectors.tfidf(items, items.count()), "tfidf"), 8, items, iterations=5)


def spectral_pic(s, d):
    return baselines.spectral(_dense(s, d), cut(baselines.connectivity(_knn(s, d, 10)), "edges"), 10, 10)


def density_clusters(s, d):
    return baselines.density(_dense(s, d), _knn(s, d, 10))


def class_terms(s, d):
    return baselines.class_terms(_items(s, d), _item_labels(s, d))


def logreg_labels(s, d):
    return baselines.logistic(_dense(s, d), _truth(s, d).where("item_id % 2 = 0"))


def flag_filter(s, d):
    return rules.chain(readers.table(s, d, "labels"), rules.flag_filter("quality", 1)).select("doc_id", "toxic")


def valid_sorted_sample(s, d):
    return rules.chain(readers.table(s, d, "orders"), rules.valid_sample(F.col("o_orderstatus") == "F", ["o_totalprice", "o_orderkey"], 40)).select("o_orderkey", F.round("o_totalprice", 2).alias("price"))


def null_issues(s, d):
    joined = readers.table(s, d, "documents").select("doc_id", "lang").join(readers.table(s, d, "labels"), "doc_id", "left")
    return rules.chain(joined, rules.null_issues("quality", "toxic")).select("doc_id", "lang")


def quality_report(s, d):
    e = {"positive quantity": F.col("l_quantity") > 0, "discount under 5 %": F.col("l_discount") < 0.05, "flag known": F.col("l_returnflag").isin("A", "N")}
    return rules.quality_report(readers.table(s, d, "lineitem"), e)


def root_causes(s, d):
    return rules.root_causes(readers.table(s, d, "events"), "event_type", "value")


def comparison_table(s, d):
    return rules.comparison(readers.table(s, d, "orders"), "o_orderpriority", "o_orderstatus", "o_totalprice", ["F", "O", "P"])


def contract_report(s, d):
    p = _items(s, d)
    return readers.contract_report(p, p.where("item_id % 3 = 0").select("item_id", (F.col("conv_id") % 4).alias("label")))


def event_windows(s, d):
    return ev.windowed(readers.table(s, d, "events"))


def rejection_by_category(s, d):
    v = readers.table(s, d, "labels").join(readers.table(s, d, "documents").select("doc_id", "lang"), "doc_id")
    return evaluate.rejection_by_category(v.select(F.col("lang").alias("category"), F.when(F.col("toxic") == 1, "reject").when(F.col("quality") == 1, "accept").otherwise("borderline").alias("verdict")))


def corrections(s, d):
    v = readers.table(s, d, "labels").join(readers.table(s, d, "documents").select("doc_id", "source"), "doc_id")
    return evaluate.corrections(v.select(F.when(F.col("quality") == 1, "accept").otherwise("reject").alias("verdict"), F.col("source").alias("correction")))


def disagreements(s, d):
    return evaluate.disagreements(_raters(s, d))


def bias_deltas(s, d):
    return evaluate.bias_deltas(_scores(s, d))


def rank_vectors(s, d):
    return evaluate.rank_vectors(_scores(s, d))


def head_to_head(s, d):
    return evaluate.head_to_head(_scores(s, d), "src0")


def cluster_summary(s, d):
    return profile.summary(_labels(s, d), _truth(s, d))


def tagged_samples(s, d):
    one = lambda n: readers.table(s, d, n)
    return sampling.tagged({"documents": one("documents").select(F.col("doc_id").alias("id"), "lang"), "pages": one("pages").select(F.col("page_id").alias("id"), "url")})


def ensemble_members(s, d):
    return clustering.best_members(_results(s, d), 8)


def cascade_metrics(s, d):
    return cascade.cascade_metrics(_long(s, d), _start(s, d), _truth(s, d))


def concept_sweep(s, d):
    items = _items(s, d)
    return clustering.concept_sweep(items, items.select("item_id", (F.col("conv_id") % 4).cast("string").alias("label")), (20, 35), (0.8,), (0.3,), (5.0,), 10)


def graph_sweep(s, d):
    marks = _dense(s, d).select("item_id", F.explode(F.transform("v", lambda x, i: F.when(x > 0.15, i))).alias("concept")).where("concept is not null")
    return clustering.graph_sweep(_dense(s, d).select("item_id"), cut(_long(s, d), "vectors"), _knn(s, d, 10), cut(marks, "marks"), _truth(s, d), (5, 10), (SIGMA,), (0, 1))


def ensemble_sweep(s, d):
    bal = s.createDataFrame([("a", 0.9), ("b", 0.1), ("c", 0.2)], "run string, bal double")
    return clustering.ensemble_sweep(_dense(s, d).select("item_id"), _knn(s, d, 10), _runs(s, d), bal, _truth(s, d), (2, None), (1.0,))


def _families(s, d):
    v = cut(_dense(s, d), "dense")
    return {"centroid": {"kmeans": lambda: baselines.kmeans(v, 8), "none": lambda: v.select("item_id", "no_such_column")}, "topics": {"own": lambda: _labels(s, d)}, "left out": {"x": lambda: _labels(s, d)}}


def baseline_suite(s, d):
    return clustering.suite(_families(s, d), _truth(s, d), skip=("left out",))


def ablation_runs(s, d):
    v = cut(_dense(s, d), "dense")
    half = cut(v.select("item_id", F.transform("v", lambda x, i: F.when(i % 2 == 0, x).otherwise(0.0)).alias("v")), "dense")
    return clustering.ablation({"all": v, "half": half}, {"k4": lambda x: baselines.kmeans(x, 4), "k8": lambda x: baselines.kmeans(x, 8)}, _truth(s, d))


def concept_idf_plus_one(s, d):
    items = _items(s, d)
    return weights.df_idf(weights.filtered(weights.item_concepts(items)), items.count(), plus=1).select("concept", "df", F.round("idf", 6).alias("idf"))


def concepts_any_script(s, d):
    return weights.item_concepts(_items(s, d), tx.ANY_SCRIPT).groupBy("concept").agg(F.count(F.lit(1)).alias("df"))


def concept_vectors_default(s, d):
    items, _, w = _weights(s, d)
    return vectors.paired_vectors(weights.filtered(weights.item_concepts(items)), w).withColumn("v", F.round("v", 6))


def hashed_vectors(s, d):
    return vectors.long_form(vectors.hashed(_items(s, d))).where("v <> 0").select("item_id", "dim", F.round("v", 6).alias("v"))


def usable_texts(s, d):
    t = F.col("text")
    return readers.table(s, d, "documents").select("doc_id", tx.usable(t).alias("judged"), tx.usable(t, 10, beyond=True).alias("profiled"), (~tx.usable(t, 5)).alias("short"), *[tx.shortened(t, n).alias(f"first_{n}") for n in (100, 800)])


#: Labels and what they are merged into.
CANONICAL = [("a:a", "vowels"), ("a:e", "vowels"), ("a:i", "vowels"), ("m:o", "vowels"), ("m:u", "vowels"), ("m:w", "half")]


def label_consolidation(s, d):
    return labelling.consolidate(_concept_labels(s, d)[1], s.createDataFrame(CANONICAL, "label string, canonical string"))


def annotation_rows(s, d):
    docs = readers.table(s, d, "documents").withColumnRenamed("doc_id", "item_id")
    truth = readers.table(s, d, "labels").select(F.col("doc_id").alias("item_id"), F.col("quality").cast("string").alias("label"))
    return sampling.annotation(sampling.uniform(docs, "item_id", 25), docs.withColumnRenamed("text", "prompt"), truth)


def cluster_preview(s, d):
    items, _, w = _weights(s, d)
    return profile.preview(_item_labels(s, d), w, items)


def spherical_refit(s, d):
    return baselines.spherical_refit(_dense(s, d), _labels(s, d))


def knn_connectivity(s, d):
    return baselines.connectivity(_knn(s, d, 10))


def topic_pairs(s, d):
    return baselines.topic_pairs(_items(s, d), _item_labels(s, d), 0.05, 200).withColumn("sim", F.round("sim", 4))


def topic_model(s, d):
    items = cut(_items(s, d), "items")
    return baselines.topic_model(items, cut(vectors.hashed(items), "hashed"))


def anomalies(s, d):
    return rules.anomalies(readers.table(s, d, "events"), "event_type", "value")


def date_range(s, d):
    return rules.chain(readers.table(s, d, "orders"), rules.between("o_orderdate", F.lit("1995-01-01").cast("date"), F.lit("1995-12-31").cast("date"))).select("o_orderkey", "o_custkey")


def category_samples(s, d):
    return labelling.category_samples(_concept_labels(s, d)[1])


def cluster_profiles_truth(s, d):
    items, _, w = _weights(s, d)
    truth = items.select("item_id", (F.col("conv_id") % 4).cast("string").alias("label"))
    return profile.profiles(_item_labels(s, d), w, items, truth).select("cluster_id", "size", F.col("gt.dominant").alias("dominant"), F.col("gt.purity").alias("purity"))


def bias_runs(s, d):
    other = _dense(s, d).select("item_id", (F.col("item_id") % 5).cast("string").alias("label"))
    methods = {"sevenths": ("fixed", lambda: _labels(s, d)), "third": ("embedding", lambda: _start(s, d)), "broken": ("fixed", lambda: _dense(s, d).select("no_such_column"))}
    return clustering.bias_runs(methods, _truth(s, d), other)


NAMES = [
    items_build, concept_drop_reason, drop_reason_counts, prompt_words, concept_df_idf, concept_weights, ppmi_prompt_response, concept_weights_strict, conv_donor, conv_propagate, cooccurrence, pmi_topk, pmi_densify, pmi_ablation,
    concept_vectors_l2, tfidf_vectors, bow_counts, hybrid_vectors, knn_dense, knn_sparse, knn_edges, knn_min_shared, isolated_nodes, graph_degrees, components, label_propagation, modularity_of_labels, leiden, centroids, assign_singletons,
    cascade_labels, cascade_rounds, cluster_metrics, nmi_ari, balanced_score, nmi_subset, purity, kappa, kappa_bootstrap, confusion, kendall_tau, bias_ratio, neighbor_entropy, uncertain_anchors, cluster_profile_concepts, cluster_profile_labels, cluster_profiles,
    cluster_size_summary, gt_propagate, category_merge, concept_frequency, label_batches, rule_labels, label_kept, label_dry_run, judge_verdicts, judge_agreement, label_normalize, verdict_parse, verdict_stats, json_label_parse, ground_truth_layouts, stratified_sample, capped_sample, uniform_sample, triplets, coassociation_edges,
    ensemble_cluster, sweep_grid, best_per_family, top_results, ablation_matrix, concept_pipeline, dense_pipeline, kmeans_dense, spherical_kmeans, pca_kmeans, lda_topics, nmf_als, spectral_pic, density_clusters, class_terms, logreg_labels, flag_filter,
    valid_sorted_sample, null_issues, quality_report, root_causes, comparison_table, contract_report, event_windows,
    rejection_by_category, corrections, disagreements, bias_deltas, rank_vectors, head_to_head, cluster_summary, tagged_samples, ensemble_members, cascade_metrics, concept_sweep, graph_sweep, ensemble_sweep, baseline_suite, ablation_runs,
    concept_idf_plus_one, concepts_any_script, concept_vectors_default, hashed_vectors, usable_texts, label_consolidation, annotation_rows, cluster_preview, spherical_refit, knn_connectivity, topic_pairs, topic_model, anomalies, date_range,
    category_samples, cluster_profiles_truth, bias_runs,
]


def queries() -> dict:
    return {f.__name__: f for f in NAMES}
