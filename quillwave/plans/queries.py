"""Registered queries of the matching engine, and what each should give in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwave.config import CepstraConfig, EndpointConfig, GateConfig, MatchConfig
from quillwave.functions.cepstra import with_features
from quillwave.functions.dtw import distance_expression, packed_values, regular, rounded_expression, with_distance
from quillwave.functions.frames import derivative, framed, low_percentile, mean_subtracted, normalise_pcm, pre_emphasised, rms, segment, trim, windowed, with_derivatives
from quillwave.operators import decide as D
from quillwave.operators import enrol as N
from quillwave.operators import evaluate as E
from quillwave.operators import longaudio, upkeep
from quillwave.operators.pairing import best_per_command, cell_side, pair_distances, pairs_met, rounded_pairs
from quillwave.operators import recognise as R
from quillwave.operators.recognise import audio_features, recognise
from quillwave.plans import oracles as O
from quillwave.plans import textcheck, views
from quillwave.plans.views import SECONDS_PER_ACCEPT, THRESHOLD
from quillwave.sources import actions as A
from quillwave.sources import store
from quillwave.shared import fresh_path, stash
from quillwave.sqlfunctions import register
from quillwave.sources.pcm import chopped
from quillwave.streaming.gate import gate_batch
from quillwave.streaming.listen import listen_batch
from quillwave.streaming.loop import PeakDecision, loop_batch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _r(c: str, digits: int = 5):
    return F.round(F.col(c).cast("double"), digits).alias(c)


def _sides(s: SparkSession, d: str, shape: str = "fixed", single: bool = False) -> tuple[DataFrame, DataFrame]:
    seq = views.sequences(s, d, shape)
    return views.queries(seq), views.single_templates(seq) if single else views.templates(seq)


def _best(s: SparkSession, d: str, shape: str = "fixed", single: bool = False, top: int | None = None) -> DataFrame:
    return best_per_command(pair_distances(*_sides(s, d, shape, single), top=top))


def _decided(s: SparkSession, d: str, thresholds: DataFrame | None = None, shape: str = "fixed") -> DataFrame:
    q, _ = _sides(s, d, shape)
    return E.decided(q.select("query_id", "truth", "condition", "duration_ms"), _best(s, d, shape, top=1), thresholds, THRESHOLD)


FIXED = O.dtw(O.FIXED)
RAGGED = O.dtw(O.RAGGED)
SINGLE = O.dtw(O.RAGGED, O.SINGLE)
DECIDED = f"{FIXED}, {O.decided()}"
TINY = MatchConfig(threshold=THRESHOLD)


# Matching ----------------------------------------------------------------------------------------------------------


@query(f"{FIXED} SELECT query_id, template_id, round(CAST(distance AS DOUBLE), 5) AS distance FROM pairs")
def dtw_distance(s, d):
    return rounded_pairs(*_sides(s, d), digits=5)


@query(f"{RAGGED} SELECT query_id, template_id, round(CAST(distance AS DOUBLE), 5) AS distance FROM pairs")
def dtw_ragged(s, d):
    return rounded_pairs(*_sides(s, d, "ragged"), digits=5)


@query(f"{FIXED} SELECT query_id, template_id, round(CAST(distance AS DOUBLE), 5) AS distance FROM pairs")
def dtw_expression(s, d):
    """The JVM-side recurrence; queries and templates meet by a grid as in `pair_distances`, but pair by pair.

    Sequences of 8 frames of 8 values, as all should be, go by a column for each cell; pairs with any other by the expression.
    """
    side, fits = cell_side(s), regular(F.col("features"), 8, 8)
    other = F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
    place = lambda key: F.pmod(F.xxhash64(key), F.lit(side)).cast("int")
    width = F.size(F.element_at("features", 1)).alias("width")

    def met(q, t, given=F.col("features")):
        q = q.select("query_id", given.alias("a"), width, place("query_id").alias("row"), other.alias("col"))
        t = t.select("template_id", given.alias("b"), width, other.alias("row"), place("template_id").alias("col"))
        return q.repartition(2 * side * side, "width", "row", "col").join(t.repartition(2 * side * side, "width", "row", "col"), ["width", "row", "col"])

    q, t = _sides(s, d)
    rest = met(q.where(~fits), t).unionByName(met(q.where(fits), t.where(~fits)))
    fast = with_distance(met(q.where(fits), t.where(fits), packed_values(F.col("features"), 8, 8)), ["query_id", "template_id"], (8, 8, 8))
    pairs = fast.unionByName(rest.select("query_id", "template_id", distance_expression(F.col("a"), F.col("b")).alias("distance")))
    return pairs.select("query_id", "template_id", rounded_expression(F.col("distance").cast("float"), 5).alias("distance"))


@query(f"{FIXED}, wide AS (SELECT vec_id FROM embeddings WHERE vec_id % 10 <> 0 AND label <= 7) SELECT q.query_id, count(p.template_id) AS met, (SELECT count(*) FROM wide) AS skipped FROM queries q LEFT JOIN pairs p ON p.query_id = q.query_id GROUP BY q.query_id")
def width_skip(s, d):
    """Templates of another width are skipped: none of the wide ones meets a query."""
    q, t = _sides(s, d)
    wide = views.templates(views.sequences(s, d, "wide")).withColumn("template_id", F.concat(F.lit("w"), "template_id"))
    met = pairs_met(q, t.unionByName(wide))
    total = t.select("template_id").union(wide.select("template_id")).agg(F.count("*")).scalar()
    return q.select("query_id").join(met, "query_id", "left").select("query_id", F.coalesce("met", F.lit(0).cast("long")).alias("met"), (total - F.coalesce("met", F.lit(0))).cast("long").alias("skipped"))


@query(f"{FIXED} SELECT query_id, command_id, template_id, round(CAST(distance AS DOUBLE), 5) AS distance FROM best")
def best_of_command(s, d):
    return _best(s, d).select("query_id", "command_id", "template_id", _r("distance"))


@query(f"{O.dtw(O.seq('16', 4), band=0.25)} SELECT query_id, command_id, template_id, round(CAST(distance AS DOUBLE), 5) AS distance FROM best")
def best_pruned(s, d):
    """Sequences long enough, and a band wide enough, for bounds to leave most pairs out."""
    q, t = _sides(s, d, "long")
    return best_per_command(pair_distances(q, t, band_ratio=0.25)).select("query_id", "command_id", "template_id", _r("distance"))


@query(f"{FIXED} SELECT query_id, command_id, template_id, round(CAST(distance AS DOUBLE), 5) AS distance, round(CAST(runner_up AS DOUBLE), 5) AS runner_up FROM ranked")
def rank_runner_up(s, d):
    return D.ranked(_best(s, d, top=2)).select("query_id", "command_id", "template_id", _r("distance"), _r("runner_up"))


def _recognised(s, d, shape="fixed", single=False, config=TINY):
    q, _ = _sides(s, d, shape, single)
    return D.decide(q.select("query_id", "frame_count"), _best(s, d, shape, single, top=2), config=config).withColumn("confidence", F.round("confidence", 4)).withColumn("distance", F.round(F.col("distance").cast("double"), 5))


@query(f"{FIXED}, {O.results(THRESHOLD)} SELECT query_id, kind, reason FROM results")
def threshold_decide(s, d):
    return _recognised(s, d).select("query_id", "kind", "reason")


@query(f"{FIXED}, {O.results(8.0)} SELECT query_id, round(confidence, 4) AS confidence FROM results")
def confidence(s, d):
    return _recognised(s, d, config=MatchConfig()).select("query_id", "confidence")


@query(f"{FIXED}, {O.results(THRESHOLD)} SELECT {O.RESULT_COLUMNS} FROM results")
def recognize(s, d):
    q, t = _sides(s, d)
    return recognise(q, t, config=TINY).withColumn("confidence", F.round("confidence", 4)).withColumn("distance", F.round(F.col("distance").cast("double"), 5))


@query(f"{FIXED}, {O.results(THRESHOLD)} SELECT {O.RESULT_COLUMNS} FROM results")
def sql_recognize(s, d):
    """`recognize` as a table function in SQL."""
    q, t = _sides(s, d)
    q.createOrReplaceTempView("asked_sequences")
    t.createOrReplaceTempView("known_templates")
    register(s, "asked_sequences", "known_templates")
    return s.sql(f"SELECT query_id, kind, command_id, template_id, round(confidence, 4) AS confidence, round(CAST(distance AS DOUBLE), 5) AS distance, reason, nearest_command_id FROM recognize(threshold => {THRESHOLD})")


@query(f"{SINGLE}, {O.results(THRESHOLD)} SELECT {O.RESULT_COLUMNS} FROM results")
def band_unreachable(s, d):
    return _recognised(s, d, "ragged", True)


@query("SELECT 't' || vec_id AS template_id, 'c' || label AS command_id FROM embeddings WHERE vec_id % 10 <> 0 AND label BETWEEN 1 AND 7")
def reserved_filter(s, d):
    _, t = _sides(s, d)
    renamed = t.withColumn("command_id", F.when(F.col("label") == 0, F.lit("__wake__")).otherwise(F.col("command_id")))
    return D.without_reserved(renamed).select("template_id", "command_id")


@query(f"{O.dtw(O.FIXED, 'queries AS (SELECT *, vec_id AS query_id FROM seq WHERE vec_id % 10 = 0), templates AS (SELECT * FROM seq WHERE vec_id % 10 <> 0 AND label = 0)')}, {O.results(0.2)} SELECT query_id, kind = 'MATCH' AS wake, CASE WHEN kind = 'MATCH' THEN round(CAST(distance AS DOUBLE), 5) END AS distance, CASE WHEN kind = 'MATCH' THEN NULL WHEN reason = 'EMPTY_INPUT' THEN 'NO_SPEECH' ELSE 'BELOW_THRESHOLD' END AS reason FROM results")
def wake_gate(s, d):
    q, t = _sides(s, d)
    wake = t.where("label = 0")
    found = D.decide(q.select("query_id", "frame_count"), best_per_command(pair_distances(q, wake)), D.wake_thresholds(wake, 0.2))
    return D.wake_decision(found).withColumn("distance", F.round(F.col("distance").cast("double"), 5))


@query(f"{FIXED}, {O.results(THRESHOLD)} SELECT query_id, command_id, coalesce(round(confidence, 4), 0.0) AS confidence, CASE reason WHEN 'BELOW_CONFIDENCE' THEN 'LOW_CONFIDENCE' WHEN 'NO_TEMPLATES' THEN 'BACKEND_UNAVAILABLE' WHEN 'EMPTY_INPUT' THEN 'NO_SPEECH' END AS rejection FROM results")
def backend_projection(s, d):
    return D.backend_projection(_recognised(s, d))


@query("SELECT vec_id AS query_id, CAST(NULL AS VARCHAR) AS command_id, CAST(0 AS DOUBLE) AS confidence, 'BACKEND_UNAVAILABLE' AS rejection FROM embeddings WHERE vec_id % 10 = 0")
def backend_noop(s, d):
    return D.unavailable_backend(_sides(s, d)[0])


# Evaluation --------------------------------------------------------------------------------------------------------


@query("SELECT 'c' || label AS command_id, CAST(min(vec_id) AS BIGINT) AS seq FROM embeddings WHERE vec_id % 10 <> 0 AND label <= 7 GROUP BY label")
def distinct_commands(s, d):
    return E.distinct_commands(_sides(s, d)[1].withColumn("seq", F.col("vec_id")))


@query(f"{SINGLE} SELECT q.query_id, b.command_id, round(CAST(b.distance AS DOUBLE), 5) AS distance FROM queries q LEFT JOIN best b ON b.query_id = q.query_id AND b.distance < CAST('Infinity' AS FLOAT)")
def distance_table(s, d):
    q, _ = _sides(s, d, "ragged", True)
    return q.select("query_id").join(E.finite(_best(s, d, "ragged", True)), "query_id", "left").select("query_id", "command_id", _r("distance"))


@query(f"{DECIDED} SELECT query_id, truth, winner, predicted FROM decided")
def decide(s, d):
    return _decided(s, d).select("query_id", "truth", "winner", "predicted")


@query(f"{DECIDED} SELECT coalesce(truth, 'OOV') AS truth, coalesce(predicted, 'REJECT') AS predicted, count(*) AS n FROM decided GROUP BY ALL")
def confusion(s, d):
    return E.confusion(_decided(s, d))


@query(f"{DECIDED} SELECT coalesce(truth, 'OOV') AS truth, count(*) FILTER (predicted IS NULL) AS reject, count(*) FILTER (predicted IS NOT NULL) AS accept FROM decided GROUP BY ALL")
def confusion_wide(s, d):
    rows = E.confusion(_decided(s, d)).withColumn("side", F.when(F.col("predicted") == "REJECT", "reject").otherwise("accept"))
    return rows.groupBy("truth").pivot("side", ["reject", "accept"]).agg(F.sum("n")).na.fill(0)


@query(f"{DECIDED} {O.OVERALL}")
def frr_overall(s, d):
    return E.overall(_decided(s, d))


@query(f"{DECIDED} SELECT truth, count(*) AS positives, avg({O.FALSE_REJECT}) AS frr FROM decided WHERE truth IS NOT NULL GROUP BY truth")
def frr_by_command(s, d):
    return E.frr_by(_decided(s, d), "truth")


@query(f"{DECIDED} SELECT condition, count(*) AS positives, avg({O.FALSE_REJECT}) AS frr FROM decided WHERE truth IS NOT NULL GROUP BY condition")
def frr_by_condition(s, d):
    return E.frr_by(_decided(s, d), "condition")


@query(f"{DECIDED} SELECT truth, condition, count(*) AS positives, avg({O.FALSE_REJECT}) AS frr FROM decided WHERE truth IS NOT NULL GROUP BY GROUPING SETS ((truth), (condition), ())")
def frr_grouping_sets(s, d):
    return E.frr_grouping_sets(_decided(s, d))


@query(f"{O.dtw(O.RAGGED)}, {O.decided()} {O.OVERALL}")
def far_rate(s, d):
    return E.overall(_decided(s, d, shape="ragged"))


def _commands(s, d):
    return E.distinct_commands(_sides(s, d)[1].withColumn("seq", F.col("vec_id")))


@query(f"{DECIDED}, {O.BUDGET} SELECT command_id, allowance FROM shares")
def budget_split(s, d):
    """The budget follows from how long the negatives are; how they are decided doesn't matter, so nothing is matched."""
    return E.budget_split(_commands(s, d), E.budget(_utterances(s, d), SECONDS_PER_ACCEPT))


@query(f"{DECIDED} SELECT winner AS command_id, query_id, round(CAST(winner_distance AS DOUBLE), 5) AS distance FROM decided WHERE truth IS NULL AND winner IS NOT NULL")
def negatives_by_winner(s, d):
    return E.negatives_by_winner(_decided(s, d)).withColumn("distance", F.round(F.col("distance").cast("double"), 5))


def _utterances(s, d):
    return _sides(s, d)[0].select("query_id", "truth", "condition", "duration_ms")


def _calibrated(s, d, best):
    return E.calibrate(_utterances(s, d), best, _commands(s, d), SECONDS_PER_ACCEPT)


@query(f"{DECIDED}, {O.BUDGET}, {O.THRESHOLDS} SELECT command_id, allowance, round(CAST(threshold AS DOUBLE), 5) AS threshold FROM thresholds")
def calibrate_thresholds(s, d):
    return _calibrated(s, d, stash(_best(s, d), "distances")).withColumn("threshold", F.round(F.col("threshold").cast("double"), 5))


_AGAIN = "again AS (SELECT d.*EXCLUDE (predicted), CASE WHEN winner_distance <= coalesce(t.threshold, CAST(0.192 AS FLOAT)) THEN winner END AS predicted FROM decided d LEFT JOIN thresholds t ON t.command_id = d.winner)"


@query(f"{DECIDED}, {O.BUDGET}, {O.THRESHOLDS}, {_AGAIN} {O.OVERALL.replace('FROM decided', 'FROM again')}")
def calibrated_report(s, d):
    """One distance table, written once: thresholds are calibrated on it and the same table is decided again."""
    best = stash(_best(s, d), "distances")
    return E.overall(E.decided(_utterances(s, d), best, _calibrated(s, d, best), THRESHOLD))


@query(f"{FIXED}, {O.decided('CAST(8 AS FLOAT)')} {O.OVERALL}")
def evaluate(s, d):
    q, t = _sides(s, d)
    return E.overall(E.decided(q.select("query_id", "truth", "condition", "duration_ms"), best_per_command(pair_distances(q, t, top=1))))


@query(" UNION ALL ".join(f"SELECT '{name}' AS name, frr, false_accepts, negative_seconds FROM ({O.dtw(O.derived(order))}, {O.decided()} {O.OVERALL})" for order, name in enumerate(("static", "delta", "delta_delta"))))
def bakeoff(s, d):
    """Static, first and second derivatives of the same sequences."""
    q, t = _sides(s, d)
    tables = {}
    for order, name in enumerate(("static", "delta", "delta_delta")):
        wide = lambda x, k=order: x.withColumn("features", with_derivatives(F.col("features"), k))
        tables[name] = best_per_command(pair_distances(wide(q), wide(t), top=1))
    return E.bake_off(tables, q.select("query_id", "truth", "condition", "duration_ms"), THRESHOLD)


@query(f"{DECIDED}, o AS ({O.OVERALL}) {O.report('delta', 3)}")
def reports(s, d):
    return E.report_lines(_decided(s, d), "delta", enrolment_failures=3, synthetic=True)


@query()
def bakeoff_audio(s, d):
    """The three front ends over recordings: enrolment, endpoints, features, matching, rates, and the table as text."""
    return E.bake_off_lines(R.bake_off_audio(views.recordings(s, d)), synthetic=True)


# Store and lookups -------------------------------------------------------------------------------------------------


@query(f"WITH {O.COMMANDS} SELECT * FROM commands ORDER BY label")
def commands_ordered(s, d):
    return views.commands(s, d).orderBy("label")


@query(f"WITH {O.COMMANDS} SELECT * FROM commands WHERE command_id = 'c3'")
def point_lookup(s, d):
    return views.commands(s, d).where(F.col("command_id") == "c3")


@query(f"WITH {O.COMMANDS} SELECT command_id, CASE WHEN command_id IN ('c1', 'c2') THEN 'new ' || label ELSE label END AS label, action FROM commands UNION ALL SELECT 'c99', 'new command', 'HOME'")
def upsert(s, d):
    old = views.commands(s, d)
    new = old.where(F.col("command_id").isin("c1", "c2")).withColumn("label", F.concat(F.lit("new "), "label")).unionByName(s.createDataFrame([("c99", "new command", "HOME")], old.schema))
    return store.upsert(old, new, "command_id")


@query(f"WITH {O.FIXED}, {O.SIDES} SELECT template_id, command_id FROM templates WHERE command_id <> 'c4'")
def delete_cascade(s, d):
    _, t = _sides(s, d)
    return store.delete_command(views.commands(s, d), t, s.createDataFrame([("c4",)], "command_id string"))[1].select("template_id", "command_id")


@query(f"WITH {O.FIXED}, {O.SIDES} SELECT template_id, command_id, condition, created_at FROM templates")
def templates_all(s, d):
    return _sides(s, d)[1].select("template_id", "command_id", "condition", "created_at")


@query(f"WITH {O.FIXED}, {O.SIDES} SELECT template_id FROM templates WHERE command_id = 'c2'")
def templates_for(s, d):
    return _sides(s, d)[1].where(F.col("command_id") == "c2").select("template_id")


@query(f"WITH {O.FIXED}, {O.SIDES} SELECT count(*) AS n FROM templates WHERE command_id = 'c2'")
def count_for(s, d):
    return _sides(s, d)[1].where(F.col("command_id") == "c2").agg(F.count("*").alias("n"))


@query(f"WITH {O.FIXED}, {O.SIDES} SELECT template_id FROM templates WHERE vec_id % 3 <> 0")
def delete_template(s, d):
    _, t = _sides(s, d)
    return store.delete_templates(t, t.where("vec_id % 3 = 0").select("template_id")).select("template_id")


def _stored(s: SparkSession, d: str) -> store.TemplateStore:
    """A store of all commands and templates, changed by parts: some put again with another condition or command, some gone."""
    made = store.TemplateStore(s, fresh_path(s, "store"), buckets=4)
    t = _sides(s, d)[1].select("vec_id", "template_id", "command_id", "condition", "created_at", "features")
    made.upsert_commands(views.commands(s, d))
    made.add_templates(t.drop("vec_id"))
    made.add_templates(t.where("vec_id % 5 = 1").drop("vec_id").withColumn("condition", F.lit("ILL")))
    made.add_templates(t.where("vec_id % 7 = 1").drop("vec_id").withColumn("command_id", F.lit("c0")))
    made.delete_templates(t.where("vec_id % 11 = 3").select("template_id"))
    made.delete_commands(s.createDataFrame([("c4",)], "command_id string"))
    return made


_STORED = f"WITH {O.FIXED}, {O.SIDES}, stored AS (SELECT template_id, CASE WHEN vec_id % 7 = 1 THEN 'c0' ELSE command_id END AS command_id, CASE WHEN vec_id % 5 = 1 AND vec_id % 7 <> 1 THEN 'ILL' ELSE condition END AS condition, created_at FROM templates WHERE vec_id % 11 <> 3 AND (vec_id % 7 = 1 OR command_id <> 'c4'))"


@query(f"{_STORED} SELECT * FROM stored")
def store_of_parts(s, d):
    """A store after changes that each wrote a part."""
    return _stored(s, d).templates().select("template_id", "command_id", "condition", "created_at")


@query(f"{_STORED} SELECT template_id, condition FROM stored WHERE command_id = 'c0'")
def store_lookup(s, d):
    """The templates of one command, from its bucket alone."""
    return _stored(s, d).templates_for("c0").select("template_id", "condition")


@query("SELECT vec_id, CASE vec_id % 6 WHEN 0 THEN 'NORMAL' WHEN 1 THEN 'TIRED' WHEN 2 THEN 'ILL' ELSE 'OTHER' END AS condition FROM embeddings")
def condition_fallback(s, d):
    stored = F.element_at(F.array(*[F.lit(c) for c in ("NORMAL", "TIRED", "ILL", "OTHER", "HOARSE", "")]), (F.col("vec_id") % 6 + 1).cast("int"))
    return views.table(s, d, "embeddings").select("vec_id", stored.alias("condition")).withColumn("condition", store.known_condition())


@query("SELECT vec_id, CAST(264 AS INTEGER) AS n_bytes, '0800000008000000' AS head, md5(array_to_string(list_transform(range(1, 65), lambda i: CAST(round(CAST(CAST(embedding[i] AS FLOAT) AS DOUBLE) * 1e6) AS BIGINT)), ',')) AS values_md5 FROM embeddings")
def feature_codec(s, d):
    """Features to bytes and back: the header as it is, and the values that come back."""
    coded = store.with_encoded(views.sequences(s, d).select("vec_id", "features"))
    back = store.with_decoded(coded.select("vec_id", F.length("raw").alias("n_bytes"), F.lower(F.hex(F.substring("raw", 1, 8))).alias("head"), "raw"))
    values = F.transform(F.flatten("features"), lambda v: F.round(v.cast("double") * 1e6).cast("long").cast("string"))
    return back.select("vec_id", "n_bytes", "head", F.md5(F.array_join(values, ",")).alias("values_md5"))


@query(f"{FIXED}, {O.results(THRESHOLD)}, {O.COMMANDS}, {O.ACTION_TABLE} SELECT query_id, command_id, action, action_label FROM results JOIN commands USING (command_id) JOIN actions USING (action) WHERE kind = 'MATCH'")
def route_action(s, d):
    return A.routed(_recognised(s, d), views.commands(s, d))


@query(f"WITH {O.COMMANDS}, {O.FIXED}, {O.SIDES} SELECT c.command_id, c.label, c.action, count(template_id) AS templates FROM commands c LEFT JOIN templates t USING (command_id) GROUP BY ALL")
def template_counts(s, d):
    return store.template_counts(views.commands(s, d), _sides(s, d)[1])


@query(f"{FIXED}, {O.results(8.0)}, {O.COMMANDS} SELECT query_id, r.command_id, coalesce(c.label, r.command_id) AS label FROM results r LEFT JOIN (SELECT * FROM commands WHERE command_id <> 'c1') c ON c.command_id = r.command_id")
def label_fallback(s, d):
    return A.labelled(_recognised(s, d, config=MatchConfig()), views.commands(s, d).where("command_id <> 'c1'")).select("query_id", "command_id", "label")


# Signals -----------------------------------------------------------------------------------------------------------

SMALL = CepstraConfig(sample_rate_hz=1000, filters=8, coefficients=6)
SMALL_ENDPOINT = EndpointConfig(min_speech_ms=20, hangover_ms=10, ratio=1.2)


def _pcm(s, d):
    return views.small_pcm(s, d)


def _flat(df: DataFrame, digits: int = 5) -> DataFrame:
    """One row a value of array<array<float>>."""
    rows = df.select("vec_id", F.posexplode("features").alias("f", "row"))
    return rows.select("vec_id", F.col("f").cast("long").alias("f"), F.posexplode("row").alias("k", "v")).select("vec_id", "f", F.col("k").cast("long").alias("k"), F.round(F.col("v").cast("double"), digits).alias("v"))


@query("SELECT vec_id, CAST(i AS BIGINT) AS i, round(CAST(CAST(trunc(embedding[i] * 32767) AS DOUBLE) / 32768 AS DOUBLE), 7) + 0.0 AS v FROM embeddings, range(1, 65) r(i)")
def pcm_normalize(s, d):
    pcm = _pcm(s, d).select("vec_id", normalise_pcm(F.transform("samples", lambda x: (x * F.lit(32767).cast("float")).cast("int"))).alias("x"))
    return pcm.select("vec_id", F.posexplode("x").alias("i", "v")).select("vec_id", (F.col("i") + 1).cast("long").alias("i"), F.round(F.col("v").cast("double"), 7).alias("v"))


@query(f"WITH {O.PCM}, {O.FRAMES} SELECT vec_id, f, CAST(i - 1 AS BIGINT) AS k, round(CAST(w[i] AS DOUBLE), 5) + 0.0 AS v FROM frames, range(1, 26) r(i)")
def framing(s, d):
    return _flat(_pcm(s, d).select("vec_id", framed(F.col("samples"), 25, 10).alias("features")))


@query(f"WITH {O.PCM}, {O.FRAMES} SELECT vec_id, f, round(CAST(CAST(sqrt(list_sum(list_transform(w, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE))) / 25) AS FLOAT) AS DOUBLE), 5) AS rms FROM frames")
def frame_rms(s, d):
    return _pcm(s, d).select("vec_id", F.posexplode(F.transform(framed(F.col("samples"), 25, 10), rms)).alias("f", "rms")).select("vec_id", F.col("f").cast("long").alias("f"), _r("rms"))


_LEVELS20 = f"WITH {O.PCM}, lv AS (SELECT vec_id, x, list_transform(range(5), lambda f: CAST(sqrt(list_sum(list_transform(x[f * 10 + 1:f * 10 + 20], lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE))) / 20) AS FLOAT)) AS e FROM pcm)"


@query(f"{_LEVELS20} SELECT vec_id, round(CAST(list_sort(e)[1] AS DOUBLE), 5) AS floor FROM lv")
def noise_floor_p10(s, d):
    return _pcm(s, d).select("vec_id", F.round(low_percentile(F.transform(framed(F.col("samples"), 20, 10), rms), 0.1).cast("double"), 5).alias("floor"))


_SEGMENT = f"""{_LEVELS20}, hot AS (SELECT vec_id, x, list_transform(e, lambda v: v >= greatest(CAST(list_sort(e)[1] * CAST(1.2 AS DOUBLE) AS FLOAT), CAST(0.001 AS FLOAT))) AS h FROM lv),
runs AS (SELECT vec_id, x, list_filter(range(2, 6), lambda i: h[i] AND h[i - 1]) AS ends FROM hot),
seg AS (SELECT vec_id, x, CASE WHEN len(ends) > 0 THEN greatest(0, (ends[1] - 2) - 1) * 10 END AS start_sample, CASE WHEN len(ends) > 0 THEN least(least(4, (ends[-1] - 1) + 1) * 10 + 20, 64) END AS end_sample FROM runs)"""


@query(f"{_SEGMENT} SELECT vec_id, CAST(start_sample AS INTEGER) AS start_sample, CAST(end_sample AS INTEGER) AS end_sample FROM seg")
def vad_segment(s, d):
    return _pcm(s, d).select("vec_id", segment(F.col("samples"), 1000, SMALL_ENDPOINT).alias("found")).select("vec_id", "found.start_sample", "found.end_sample")


@query(f"{_SEGMENT} SELECT vec_id, CAST(coalesce(end_sample - start_sample, 0) AS INTEGER) AS n, round(coalesce(CAST(list_sum(list_transform(x[start_sample + 1:end_sample], lambda v: CAST(v AS DOUBLE))) AS DOUBLE), 0), 5) AS total FROM seg")
def vad_trim(s, d):
    rows = _pcm(s, d).select("vec_id", trim(F.col("samples"), segment(F.col("samples"), 1000, SMALL_ENDPOINT)).alias("x"))
    return rows.select("vec_id", F.size("x").alias("n"), F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double")), 5).alias("total"))


@query(f"WITH {O.EMPHASISED} SELECT vec_id, CAST(i - 1 AS BIGINT) AS i, round(CAST(x[i] AS DOUBLE), 5) + 0.0 AS v FROM pcm, range(1, 65) r(i)")
def pre_emphasis(s, d):
    rows = _pcm(s, d).select("vec_id", F.posexplode(pre_emphasised(F.col("samples"), 0.97)).alias("i", "v"))
    return rows.select("vec_id", F.col("i").cast("long").alias("i"), _r("v"))


_WIN = f"WITH {O.EMPHASISED}, {O.FRAMES}, {O.POWER}"


@query(f"{_WIN} SELECT vec_id, f, CAST(i - 1 AS BIGINT) AS k, round(CAST(w[i] AS DOUBLE), 5) + 0.0 AS v FROM win, range(1, 26) r(i)")
def hamming(s, d):
    frames = F.transform(framed(pre_emphasised(F.col("samples"), 0.97), 25, 10), lambda f: windowed(f, 25))
    return _flat(_pcm(s, d).select("vec_id", frames.alias("features")))


@query(f"{_WIN} SELECT vec_id, f, k, round(CAST(p AS DOUBLE), 5) + 0.0 AS v FROM power")
def power_spectrum(s, d):
    return _flat(with_features(_pcm(s, d), SMALL, keep=["vec_id"], stage="power"))


@query(f"{_WIN}, {O.MEL} SELECT vec_id, f, filter AS k, round(CAST(e AS DOUBLE), 4) + 0.0 AS v FROM mel")
def log_mel(s, d):
    return _flat(with_features(_pcm(s, d), SMALL, keep=["vec_id"], stage="log_mel"), 4)


@query(f"{_WIN}, {O.MEL}, {O.CEPSTRA} SELECT vec_id, f, c AS k, round(CAST(v AS DOUBLE), 4) + 0.0 AS v FROM cep")
def dct_lifter(s, d):
    return _flat(with_features(_pcm(s, d), SMALL, keep=["vec_id"], stage="dct_lifter"), 4)


@query(f"WITH {O.FIXED} SELECT vec_id, CAST(f - 1 AS BIGINT) AS f, CAST(k - 1 AS BIGINT) AS k, round(CAST(CAST(features[f][k] - CAST(list_sum(list_transform(features, lambda x: CAST(x[k] AS DOUBLE))) / 8 AS FLOAT) AS FLOAT) AS DOUBLE), 5) + 0.0 AS v FROM seq, range(1, 9) a(f), range(1, 9) b(k)")
def cmvn(s, d):
    return _flat(views.sequences(s, d).select("vec_id", mean_subtracted(F.col("features")).alias("features")))


_DELTA = "CAST((features[least(f + 1, 8)][k] - features[greatest(f - 1, 1)][k]) / CAST(2 AS FLOAT) AS FLOAT)"


@query(f"WITH {O.FIXED} SELECT vec_id, CAST(f - 1 AS BIGINT) AS f, CAST(k - 1 AS BIGINT) AS k, round(CAST({_DELTA} AS DOUBLE), 5) + 0.0 AS v FROM seq, range(1, 9) a(f), range(1, 9) b(k)")
def delta(s, d):
    return _flat(views.sequences(s, d).select("vec_id", derivative(F.col("features")).alias("features")))


@query(f"{_WIN}, {O.MEL}, {O.CEPSTRA}, {O.mfcc(0)}")
def mfcc_static(s, d):
    return _flat(with_features(_pcm(s, d), SMALL, keep=["vec_id"]), 4)


@query(f"{_WIN}, {O.MEL}, {O.CEPSTRA}, {O.mfcc(1)}")
def mfcc_delta(s, d):
    return _flat(with_features(_pcm(s, d), CepstraConfig(sample_rate_hz=1000, filters=8, coefficients=6, delta=1), keep=["vec_id"]), 4)


@query(f"{_WIN}, {O.MEL}, {O.CEPSTRA}, {O.mfcc(2)}")
def mfcc_delta_delta(s, d):
    return _flat(with_features(_pcm(s, d), CepstraConfig(sample_rate_hz=1000, filters=8, coefficients=6, delta=2), keep=["vec_id"]), 4)


@query(O.LONG_SEGMENTS)
def long_segments(s, d):
    """Endpoints of recordings that lie in chunks, worked out in blocks of 16 frames."""
    return longaudio.segments(views.long_recordings(s, d), 1000, SMALL_ENDPOINT, block_frames=16)


@query(f"WITH {O.LONG_FRAMES}, {O.POWER}, {O.MEL}, {O.CEPSTRA}, {O.LONG_DELTA}")
def long_features(s, d):
    """Coefficients less their mean over a whole recording, and first derivatives, in blocks of 16 frames."""
    rows = longaudio.features(views.long_recordings(s, d), CepstraConfig(sample_rate_hz=1000, filters=8, coefficients=6, delta=1), block_frames=16)
    flat = rows.select(F.col("recording_id").alias("vec_id"), "first", F.posexplode("features").alias("i", "row"))
    return flat.select("vec_id", (F.col("first") + F.col("i")).alias("f"), F.posexplode("row").alias("k", "v")).select("vec_id", "f", F.col("k").cast("long").alias("k"), (F.round(F.col("v").cast("double"), 3) + 0.0).alias("v"))


@query(O.SIGNALS)
def synthetic_signals(s, d):
    """The recordings in short: a row a signal."""
    x = views.recordings(s, d)
    return x.select("seq", "kind", "truth", "condition", F.size("samples").alias("n"), F.round(rms(F.col("samples")).cast("double"), 4).alias("rms"))


@query()
def recognize_audio(s, d):
    """Audio to decisions over recordings at the default parameters."""
    templates, _ = R.enrol_audio(views.recordings(s, d, "kind = 'enrol'").withColumn("command_id", F.col("truth")), prefix="t")
    asked = audio_features(views.recordings(s, d, "kind <> 'enrol'")).select(F.col("seq").alias("query_id"), "features", "frame_count", "silent")
    return recognise(asked, templates).withColumn("distance", F.round(F.col("distance").cast("double"), 3)).withColumn("confidence", F.round("confidence", 3))


# Enrolment and adaptation ------------------------------------------------------------------------------------------

_COUNT = "CASE vec_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 400 ELSE 8000 END"


def _offers(s, d):
    judged = F.expr(f"{_COUNT}").alias("sample_count"), F.expr("vec_id % 4 = 2").alias("silent"), (F.col("vec_id") % 13).cast("int").alias("frame_count")
    return views.table(s, d, "embeddings").select("vec_id", *judged)


_REASON = f"CASE WHEN {_COUNT} = 0 THEN 'TOO_SHORT' WHEN vec_id % 4 = 2 THEN 'SILENT' WHEN vec_id % 13 < 8 THEN 'TOO_FEW_FRAMES' END"


@query(f"SELECT vec_id, {_REASON} AS reason FROM embeddings")
def enroll_quality(s, d):
    return N.quality_reason(_offers(s, d)).select("vec_id", "reason")


@query(f"SELECT 'eval-' || seq AS template_id, CAST(seq AS BIGINT) AS created_at FROM (SELECT row_number() OVER (ORDER BY vec_id) AS seq, {_REASON} AS reason FROM embeddings) WHERE reason IS NULL")
def bulk_enroll(s, d):
    return N.bulk_enrol(N.quality_reason(N.numbered(_offers(s, d), "vec_id")))[0].select("template_id", "created_at")


_EXISTING = "queries AS (SELECT *, template_id AS query_id FROM seq), templates AS (SELECT * FROM seq)"
_SCORES = f"{O.dtw(O.FIXED, _EXISTING, on='q.command_id = t.command_id')}, scores AS (SELECT t.command_id, t.template_id, t.condition, t.created_at, CAST(min(p.distance) AS DOUBLE) AS score FROM templates t LEFT JOIN (SELECT p.*, q.command_id AS own FROM pairs p JOIN queries q ON q.query_id = p.query_id) p ON p.query_id = t.template_id AND p.own = p.command_id AND p.template_id <> t.template_id GROUP BY ALL)"


def _scored(s, d):
    rows = views.sequences(s, d)
    pairs = pair_distances(rows.withColumn("query_id", F.col("template_id")), rows, within="command_id", apart=True)
    same = pairs.select("command_id", F.col("query_id").alias("a"), F.col("template_id").alias("b"), "distance")
    return N.redundancy(same, rows.select("command_id", "template_id", "condition", "created_at"))


@query(f"{_SCORES} SELECT template_id, command_id, round(coalesce(score, 1e9), 5) AS score FROM scores")
def redundancy_score(s, d):
    return _scored(s, d).select("template_id", "command_id", F.round(F.least("score", F.lit(1e9)), 5).alias("score"))


@query(
    f"{_SCORES}, counted AS (SELECT *, count(*) OVER (PARTITION BY command_id, condition) AS bucket, count(*) OVER (PARTITION BY command_id) AS total FROM scores), victims AS (SELECT *, row_number() OVER (PARTITION BY command_id ORDER BY coalesce(score, 1e300), created_at, template_id) AS rn FROM counted WHERE total + 1 > 4 AND bucket >= 2) "
    "SELECT DISTINCT 'add' AS op, command_id, 'new-' || command_id AS template_id FROM scores UNION ALL SELECT 'remove', command_id, template_id FROM victims WHERE rn = 1"
)
def adaptation(s, d):
    scored = _scored(s, d)
    new = scored.select("command_id").distinct().withColumn("template_id", F.concat(F.lit("new-"), "command_id"))
    return N.adaptation(scored, new, most=4)


_CHANGED = "queries AS (SELECT *, template_id AS query_id FROM seq WHERE vec_id % 11 <> 5), templates AS (SELECT * FROM seq WHERE vec_id % 11 <> 5)"


@query(f"{O.dtw(O.FIXED, _CHANGED, on='q.command_id = t.command_id')}, near AS (SELECT p.*, q.template_id AS own, row_number() OVER (PARTITION BY p.query_id ORDER BY p.distance, p.template_id) AS nth FROM pairs p JOIN queries q ON q.query_id = p.query_id WHERE p.template_id <> p.query_id) SELECT t.template_id, t.command_id, round(coalesce(CAST(n.distance AS DOUBLE), 1e9), 5) AS score, n.template_id AS nearest FROM templates t LEFT JOIN near n ON n.query_id = t.template_id AND n.nth = 1")
def redundancy_upkeep(s, d):
    """Scores of a table that every seventh row has come to and every eleventh has left, from the scores before."""
    rows = views.sequences(s, d).select("vec_id", "template_id", "command_id", "created_at", "features")
    before = rows.where("vec_id % 7 <> 2")
    scores = stash(upkeep.scored(before), "scores")
    after = rows.where("vec_id % 11 <> 5")
    new, gone = after.where("vec_id % 7 = 2").select("template_id"), before.where("vec_id % 11 = 5").select("template_id")
    return upkeep.rescored(scores, after, new, gone).select("template_id", "command_id", F.round(F.least("score", F.lit(1e9)), 5).alias("score"), "nearest")


# Streams (as batches; the streaming forms are in the tests) --------------------------------------------------------

LOUD = GateConfig(floor=1.0)


@query(f"{O.GATE} SELECT device_id, seq, speech, CAST(floor(floor * 100000 + 0.123) AS BIGINT) AS floor_e5 FROM gate WHERE n > 0")
def energy_gate(s, d):
    return gate_batch(views.levels(s, d), LOUD).select("device_id", "seq", "speech", F.floor(F.col("floor") * 100000 + 0.123).alias("floor_e5"))


@query(f"{O.GATE} SELECT device_id, count(*) FILTER (speech) AS n_speech, count(*) AS n FROM gate WHERE n > 0 GROUP BY device_id")
def energy_gate_fold(s, d):
    """Speech of each device, from rows that stream through; the fold over an array (`gate_fold`) is for short runs."""
    return gate_batch(views.levels(s, d), LOUD).groupBy("device_id").agg(F.count_if("speech").alias("n_speech"), F.count("*").alias("n"))


@query(O.LISTEN)
def listen_refractory(s, d):
    events = views.table(s, d, "events")
    return listen_batch(events.select(F.col("user_id").alias("device_id"), (F.col("event_id") * 50).alias("at_ms"), (F.col("value") > 90).alias("hit")))


@query(O.LOOP)
def listen_loop(s, d):
    """Windows that are decided as they fill, with templates that come and go; a match or their absence moves the next one."""
    made = loop_batch(views.loop_rows(s, d), PeakDecision(MatchConfig(threshold=2.0)))
    return made.select("device_id", "window_id", "start", "end", "idle_steps", "kind", "command_id", "template_id", F.round(F.when(F.col("distance") < F.lit(float("inf")), F.col("distance").cast("double")), 5).alias("distance"), "reason")


@query(f"WITH {O.PCM} SELECT vec_id AS device_id, CAST(i AS INTEGER) AS seq, CAST(CASE WHEN i = 3 THEN 4 ELSE 20 END AS INTEGER) AS n FROM pcm, range(4) r(i)")
def capture_frames(s, d):
    return chopped(_pcm(s, d).withColumnRenamed("vec_id", "device_id"), 20).select("device_id", "seq", F.size("samples").alias("n"))


# Text checks -------------------------------------------------------------------------------------------------------

for _name, (_run, _sql) in textcheck.CHECKS.items():
    QUERIES[_name] = _run
    if _sql:
        ORACLES[_name] = _sql


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognize(spark, sf_dir)
