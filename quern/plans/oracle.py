"""SQL, for DuckDB, that gives the same rows as the queries of ``catalog``."""

from __future__ import annotations

_WORKLOAD = "['faq', 'code', 'chat'][CAST(pair_no % 3 + 1 AS INTEGER)]"


def _unit(v: str) -> str:
    length = f"sqrt(list_sum(list_transform({v}, lambda x: x * x)))"
    return f"CASE WHEN {length} = 0 THEN {v} ELSE list_transform({v}, lambda y: y / {length}) END"


_PAIRS = f"""
vectors AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
base AS (
  SELECT a.vec_id // 2 AS pair_no, a.vec_id AS id_a, b.vec_id AS id_b, a.v AS va, b.v AS vb, a.label AS label_a, b.label AS label_b,
    CASE WHEN a.label = b.label THEN 1 ELSE 0 END AS original_label
  FROM vectors a JOIN vectors b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0),
pairs AS (
  SELECT *, {_WORKLOAD} AS workload, printf('%s-%06d', {_WORKLOAD}, pair_no) AS pair_id,
    CASE WHEN pair_no % 5 = 0 THEN NULL WHEN pair_no % 7 = 0 THEN 1 - original_label ELSE original_label END AS author_label
  FROM base),
modelled AS (
  SELECT m.model, p.workload, p.pair_id, p.pair_no AS seq, coalesce(p.author_label, p.original_label) AS label,
    {_unit("p.va[1:m.width]")} AS v1, {_unit("p.vb[1:m.width]")} AS v2
  FROM pairs p, (VALUES ('m64', 64), ('m32', 32)) m(model, width))
"""


def _swept(thresholds: str) -> str:
    """Common tables up to ``decisions``: every configuration replayed in order."""
    return f"""WITH RECURSIVE {_PAIRS},
grid AS (SELECT m.model, w.workload, t.threshold, printf('%s|%s|%.2f', m.model, w.workload, t.threshold) AS config_id
  FROM (VALUES ('m64'), ('m32')) m(model), (VALUES ('faq'), ('code'), ('chat')) w(workload), (SELECT CAST(unnest([{thresholds}]) AS DOUBLE) AS threshold) t),
requests AS (
  SELECT config_id, threshold, v, label, pair_id, place, model, workload, row_number() OVER (PARTITION BY config_id ORDER BY seq, place) AS i
  FROM (SELECT g.config_id, g.threshold, g.model, g.workload, p.label, p.pair_id, p.seq, 0 AS place, p.v1 AS v FROM grid g JOIN modelled p USING (model, workload)
    UNION ALL SELECT g.config_id, g.threshold, g.model, g.workload, p.label, p.pair_id, p.seq, 1, p.v2 FROM grid g JOIN modelled p USING (model, workload))),
replayed AS (
  SELECT config_id, CAST(0 AS BIGINT) AS i, CAST([] AS DOUBLE[][]) AS stored, CAST(NULL AS DOUBLE) AS sim, false AS hit FROM grid
  UNION ALL
  SELECT config_id, i, CASE WHEN sim >= threshold THEN stored ELSE list_append(stored, v) END, sim, coalesce(sim >= threshold, false)
  FROM (SELECT q.config_id, q.i, q.v, q.threshold, r.stored, 1 / (1 + list_min(list_transform(r.stored, lambda s: list_distance(s, q.v)))) AS sim
    FROM replayed r JOIN requests q ON q.config_id = r.config_id AND q.i = r.i + 1)),
decisions AS (
  SELECT q.config_id, q.model, q.workload, q.threshold, q.pair_id, q.label, r.hit, r.sim,
    CASE WHEN r.hit AND q.label = 1 THEN 'TP' WHEN r.hit THEN 'FP' WHEN q.label = 1 THEN 'FN' ELSE 'TN' END AS outcome
  FROM requests q JOIN replayed r USING (config_id, i) WHERE q.place = 1),
counts AS (
  SELECT config_id, model, workload, threshold, count(*) AS n, count(*) FILTER (outcome = 'TP') AS tp, count(*) FILTER (outcome = 'FP') AS fp,
    count(*) FILTER (outcome = 'TN') AS tn, count(*) FILTER (outcome = 'FN') AS fn FROM decisions GROUP BY ALL),
rated AS (
  SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS "precision", CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall,
    CASE WHEN fp + tn = 0 THEN 0.0 ELSE fp / (fp + tn) END AS fpr, CASE WHEN n = 0 THEN 0.0 ELSE (tp + fp) / n END AS hit_rate FROM counts),
evaluated AS (
  SELECT *, CASE WHEN "precision" + recall = 0 THEN 0.0 ELSE 1.25 * "precision" * recall / (0.25 * "precision" + recall) END AS f0_5,
    tp + fp = 0 AS precision_zero_div, tp + fn = 0 AS recall_zero_div, fp + tn = 0 AS fpr_zero_div FROM rated)
"""


_CALIBRATED = "0.45, 0.46, 0.47, 0.48, 0.49"

_NEAREST = f"""unit AS (SELECT vec_id, {_unit("CAST(embedding AS DOUBLE[])")} AS v FROM embeddings),
ranked AS (
  SELECT q.vec_id AS query_id, s.vec_id AS neighbour_id, list_distance(q.v, s.v) AS distance,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.v, s.v), s.vec_id) AS rank
  FROM unit q JOIN unit s ON q.vec_id <> s.vec_id WHERE q.vec_id % 20 = 0)"""


def _kappa(source: str, columns: str) -> str:
    return f"""SELECT {columns}, CASE WHEN n_annotated = 0 THEN NULL WHEN abs(pe - 1) <= 1e-9 THEN CASE WHEN abs(po - 1) <= 1e-9 THEN 1.0 ELSE 0.0 END ELSE (po - pe) / (1 - pe) END AS k
FROM (SELECT *, (tp + tn) / nullif(n_annotated, 0) AS po,
  ((tp + fp) / nullif(n_annotated, 0)) * ((tp + fn) / nullif(n_annotated, 0)) + ((fn + tn) / nullif(n_annotated, 0)) * ((fp + tn) / nullif(n_annotated, 0)) AS pe FROM {source})"""


def _contingency(first: str, second: str) -> str:
    return f"""count(*) FILTER ({first} = 1 AND {second} = 1) AS tp, count(*) FILTER ({first} <> 1 AND {second} = 1) AS fp,
  count(*) FILTER ({first} = 1 AND {second} <> 1) AS fn, count(*) FILTER ({first} <> 1 AND {second} <> 1) AS tn, count({second}) AS n_annotated, count(*) - count({second}) AS n_excluded"""


_TRAFFIC = """traffic AS (
  SELECT event_id AS seq, ts, user_id, event_type, CASE WHEN event_id % 7 < 2 THEN 'exact_cache' WHEN event_id % 7 < 3 THEN 'semantic_cache' WHEN event_id % 7 < 6 THEN 'llm' END AS source,
    event_id % 97 AS tokens, "value" AS latency_ms, round(0.7 + (user_id % 3) / 10.0, 1)::DOUBLE AS threshold FROM events),
done AS (SELECT * FROM traffic WHERE source IS NOT NULL)"""

_COUNTERS = """count(*) AS total_requests, count(*) FILTER (source = 'exact_cache') AS exact_hits, count(*) FILTER (source = 'semantic_cache') AS semantic_hits,
  count(*) FILTER (source = 'llm') AS misses, coalesce(sum(tokens) FILTER (source <> 'llm'), 0)::BIGINT AS tokens_saved"""

_DATASET = f"""WITH {_PAIRS},
dataset AS (
  SELECT pair_id, workload, 'vectors' AS source_corpus, CAST(pair_no AS VARCHAR) AS source_pair_id, 'says "' || id_a || '", twice' || chr(10) || 'over' AS query_1,
    'vector, ' || id_b AS query_2, original_label, CAST(author_label AS INTEGER) AS author_label, CAST(label_a AS VARCHAR) AS meta_label, CAST(label_b AS VARCHAR) AS meta_other, pair_no FROM pairs)
"""

_DECIDED = f"""WITH {_TRAFFIC},
decided AS (
  SELECT seq, 'r' || seq AS request_id, CAST(epoch(date_trunc('second', ts)) AS DOUBLE) AS arrival_ts, CAST(epoch(date_trunc('second', ts)) + 1 AS DOUBLE) AS completion_ts,
    CASE WHEN user_id % 2 = 0 THEN 'even' END AS canonical_name, 'say "' || event_type || '"' AS prompt, event_type AS answer, tokens, source,
    CASE source WHEN 'exact_cache' THEN 1.0 WHEN 'semantic_cache' THEN 0.875 END::DOUBLE AS similarity, threshold FROM done)
"""

SQL: dict[str, str] = {
    "exact_replay": """SELECT doc_id AS seq, sha256(text) AS key, min(doc_id) OVER (PARTITION BY text) AS first_seq, doc_id > min(doc_id) OVER (PARTITION BY text) AS exact_hit FROM documents""",
    "exact_hit_rate_by_lang": """SELECT lang, count(*) AS requests, count(*) FILTER (hit) AS hits, round(100.0 * count(*) FILTER (hit) / count(*), 6) AS hit_rate_pct
FROM (SELECT lang, doc_id > min(doc_id) OVER (PARTITION BY text) AS hit FROM documents) GROUP BY lang""",
    "exact_lookup_expiry": """WITH store AS (SELECT text, max(doc_id) AS doc_id FROM documents GROUP BY text)
SELECT d.doc_id, (s.doc_id % 3 = 0 OR s.doc_id + 500 >= 900) AS exact_hit, CASE WHEN s.doc_id % 3 = 0 OR s.doc_id + 500 >= 900 THEN CAST(s.doc_id AS VARCHAR) END AS response_text
FROM documents d JOIN store s USING (text)""",
    "store_upsert_delete": """SELECT key, created_at, status FROM (
  SELECT CAST(o_custkey AS VARCHAR) AS key, o_orderkey AS created_at, o_orderstatus AS status, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders)
WHERE r = 1 AND key NOT IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal < 0)""",
    "l2_normalize": f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * label) AS v FROM embeddings), u AS (SELECT vec_id, {_unit("v")} AS u FROM v)
SELECT vec_id, round(sqrt(list_sum(list_transform(u, lambda x: x * x))), 6) AS norm, round(u[1], 6) + 0.0 AS first, round(u[-1], 6) + 0.0 AS last FROM u""",
    "nn_top1": f"""WITH {_NEAREST} SELECT query_id, neighbour_id, round(distance, 6) AS distance, round(1 / (1 + distance), 6) AS similarity FROM ranked WHERE rank = 1""",
    "nn_topk": f"""WITH {_NEAREST} SELECT query_id, rank, neighbour_id, round(distance, 6) AS distance, round(1 / (1 + distance), 6) AS similarity FROM ranked WHERE rank <= 10""",
    "ivf_recall": """SELECT count(*) AS queries, CAST(sum(least(10, n - 1)) AS BIGINT) AS neighbours, true AS reached
FROM embeddings, (SELECT count(*) AS n FROM embeddings) WHERE vec_id % 20 = 0""",
    "nn_cells": f"""WITH {_NEAREST} SELECT query_id, rank, neighbour_id, round(distance, 6) AS distance, round(1 / (1 + distance), 6) AS similarity FROM ranked WHERE rank <= 10""",
    "semantic_decisions_grid": f"""WITH {_NEAREST}, t AS (SELECT CAST(unnest([{_CALIBRATED}]) AS DOUBLE) AS threshold)
SELECT query_id, threshold, 1 / (1 + distance) >= threshold AS hit, CASE WHEN 1 / (1 + distance) >= threshold THEN neighbour_id END AS matched_id, round(1 / (1 + distance), 6) AS similarity FROM ranked, t WHERE rank = 1""",
    "greedy_semantic_replay": f"""WITH RECURSIVE q AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS i, {_unit("CAST(embedding AS DOUBLE[])")} AS v FROM embeddings),
r AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(id BIGINT, v DOUBLE[])[]) AS stored, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS DOUBLE) AS sim, CAST(NULL AS BIGINT) AS matched
  UNION ALL
  SELECT i, CASE WHEN sim >= 0.47 THEN stored ELSE list_append(stored, {{'id': vec_id, 'v': v}}) END, vec_id, sim, stored[list_position(d, list_min(d))].id
  FROM (SELECT *, 1 / (1 + list_min(d)) AS sim FROM (SELECT q.i, q.vec_id, q.v, r.stored, list_transform(r.stored, lambda s: list_distance(s.v, q.v)) AS d FROM r JOIN q ON q.i = r.i + 1)))
SELECT seq, CASE WHEN sim >= 0.47 THEN 'semantic_cache' ELSE 'llm' END AS source, CASE WHEN sim >= 0.47 THEN round(sim, 6) END AS similarity, CASE WHEN sim >= 0.47 THEN matched END AS matched_seq, NOT coalesce(sim >= 0.47, false) AS stored
FROM r WHERE i > 0""",
    "cascade_replay": f"""WITH RECURSIVE q AS (SELECT label, vec_id, CAST(vec_id * 7 % 31 AS VARCHAR) AS key, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i, {_unit("CAST(embedding AS DOUBLE[])")} AS v FROM embeddings),
r AS (
  SELECT DISTINCT label, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(key VARCHAR, id BIGINT)[]) AS store, CAST([] AS STRUCT(id BIGINT, v DOUBLE[])[]) AS idx, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS source, CAST(NULL AS DOUBLE) AS sim, CAST(NULL AS BIGINT) AS matched FROM embeddings
  UNION ALL
  SELECT label, i, CASE WHEN source = 'llm' THEN list_append(CASE WHEN len(store) >= 8 THEN store[2:] ELSE store END, {{'key': key, 'id': vec_id}}) ELSE store END,
    CASE WHEN source = 'llm' THEN list_append(idx, {{'id': vec_id, 'v': v}}) ELSE idx END, vec_id, source,
    CASE source WHEN 'exact_cache' THEN 1.0 WHEN 'semantic_cache' THEN sim END, CASE source WHEN 'exact_cache' THEN store[e].id WHEN 'semantic_cache' THEN idx[list_position(d, list_min(d))].id END
  FROM (SELECT *, CASE WHEN e > 0 THEN 'exact_cache' WHEN sim >= 0.48 THEN 'semantic_cache' ELSE 'llm' END AS source FROM (SELECT *, 1 / (1 + list_min(d)) AS sim FROM (
    SELECT q.label, q.i, q.vec_id, q.key, q.v, r.store, r.idx, coalesce(list_position(list_transform(r.store, lambda s: s.key), q.key), 0) AS e, list_transform(r.idx, lambda s: list_distance(s.v, q.v)) AS d
    FROM r JOIN q ON q.label = r.label AND q.i = r.i + 1))))
SELECT label, seq, source, round(sim, 6) AS similarity, matched AS matched_seq, source = 'llm' AS stored FROM r WHERE i > 0""",
    "fifo_replay": """WITH RECURSIVE q AS (SELECT lang, doc_id, sha256(text) AS key, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i FROM documents),
r AS (
  SELECT DISTINCT lang, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(key VARCHAR, id BIGINT)[]) AS store, CAST(NULL AS BIGINT) AS seq, CAST(0 AS INTEGER) AS e, CAST(NULL AS BIGINT) AS matched FROM documents
  UNION ALL
  SELECT lang, i, CASE WHEN e > 0 THEN store ELSE list_append(CASE WHEN len(store) >= 50 THEN store[2:] ELSE store END, {'key': key, 'id': doc_id}) END, doc_id, e, CASE WHEN e > 0 THEN store[e].id END
  FROM (SELECT q.lang, q.i, q.doc_id, q.key, r.store, coalesce(list_position(list_transform(r.store, lambda s: s.key), q.key), 0)::INTEGER AS e FROM r JOIN q ON q.lang = r.lang AND q.i = r.i + 1))
SELECT lang, seq, CASE WHEN e > 0 THEN 'exact_cache' ELSE 'llm' END AS source, matched AS matched_seq, e = 0 AS stored FROM r WHERE i > 0""",
    "expiry_hot_keys": """WITH RECURSIVE q AS (SELECT coalesce(source, '') AS key, doc_id FROM documents),
stores AS (
  SELECT key, min(doc_id) AS seq FROM q GROUP BY key
  UNION ALL
  SELECT s.key, min(n.doc_id) FROM stores s JOIN q n ON n.key = s.key AND n.doc_id > s.seq + 50 GROUP BY s.key),
matched AS (SELECT q.doc_id AS seq, s.seq AS held FROM q ASOF JOIN stores s ON s.key = q.key AND q.doc_id >= s.seq)
SELECT seq, CASE WHEN held = seq THEN 'llm' ELSE 'exact_cache' END AS source, CASE WHEN held <> seq THEN held END AS matched_seq, held = seq AS stored FROM matched""",
    "ttl_replay": """WITH RECURSIVE q AS (SELECT user_id, event_type, event_id, CAST(epoch(date_trunc('second', ts)) AS DOUBLE) AS now, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS i FROM events),
r AS (
  SELECT user_id, event_type, i, event_id AS seq, 'llm' AS source, CAST(NULL AS BIGINT) AS matched, now + 86400 AS expires, event_id AS held FROM q WHERE i = 1
  UNION ALL
  SELECT q.user_id, q.event_type, q.i, q.event_id, CASE WHEN q.now > r.expires THEN 'llm' ELSE 'exact_cache' END, CASE WHEN q.now > r.expires THEN NULL ELSE r.held END,
    CASE WHEN q.now > r.expires THEN q.now + 86400 ELSE r.expires END, CASE WHEN q.now > r.expires THEN q.event_id ELSE r.held END
  FROM r JOIN q ON q.user_id = r.user_id AND q.event_type = r.event_type AND q.i = r.i + 1)
SELECT user_id, seq, source, matched AS matched_seq FROM r""",
    "pair_decisions": f"""WITH {_PAIRS}, t AS (SELECT CAST(unnest([{_CALIBRATED}]) AS DOUBLE) AS threshold), s AS (SELECT model, pair_id, label, 1 / (1 + list_distance(v1, v2)) AS sim FROM modelled)
SELECT model, pair_id, threshold, round(sim, 6) AS similarity, CASE WHEN sim >= threshold AND label = 1 THEN 'TP' WHEN sim >= threshold THEN 'FP' WHEN label = 1 THEN 'FN' ELSE 'TN' END AS outcome FROM s, t""",
    "sweep_decisions": f"""{_swept(_CALIBRATED)}
SELECT config_id, model, workload, printf('%.2f', threshold) AS threshold, pair_id, CASE WHEN hit THEN 'hit' ELSE 'miss' END AS decision, CASE WHEN hit THEN 'semantic_cache' ELSE 'llm' END AS source, CAST(label AS VARCHAR) AS label, outcome FROM decisions""",
    "confusion_sweep": f"""{_swept(_CALIBRATED)}
SELECT config_id, model, workload, threshold, n, tp, fp, tn, fn, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f0_5, 6) AS f0_5, round(fpr, 6) AS fpr, round(hit_rate, 6) AS hit_rate,
  precision_zero_div, recall_zero_div, fpr_zero_div FROM evaluated""",
    "frozen_grid_metrics": f"""{_swept("0.7, 0.75, 0.8, 0.85, 0.9")}
SELECT config_id, model, workload, printf('%.2f', threshold) AS threshold, CAST(n AS VARCHAR) AS n, CAST(tp AS VARCHAR) AS tp, CAST(fp AS VARCHAR) AS fp, CAST(tn AS VARCHAR) AS tn, CAST(fn AS VARCHAR) AS fn,
  printf('%.6f', "precision"::DOUBLE) AS "precision", printf('%.6f', recall::DOUBLE) AS recall, printf('%.6f', f0_5::DOUBLE) AS f0_5, printf('%.6f', fpr::DOUBLE) AS fpr, printf('%.6f', hit_rate::DOUBLE) AS hit_rate,
  CASE WHEN precision_zero_div THEN 'True' ELSE 'False' END AS precision_zero_div, CASE WHEN recall_zero_div THEN 'True' ELSE 'False' END AS recall_zero_div, CASE WHEN fpr_zero_div THEN 'True' ELSE 'False' END AS fpr_zero_div FROM evaluated""",
    "sanity_violations": """WITH c AS (
  SELECT lang || '|' || source AS config_id, count(*) AS n, count(*) FILTER (quality = 1 AND toxic = 0) AS tp, count(*) FILTER (quality = 1 AND toxic <> 0) AS fp,
    count(*) FILTER (quality <> 1 AND toxic <> 0) AS tn, count(*) FILTER (quality <> 1 AND toxic = 0) AS fn FROM documents JOIN labels USING (doc_id) GROUP BY 1)
SELECT config_id, n + 1 AS n, tp, fp, tn, fn FROM c WHERE n % 3 = 0""",
    "grid_enumeration": """SELECT CAST(row_number() OVER (ORDER BY m.i, w.i, t.i) - 1 AS INTEGER) AS position, printf('%s|%s|%.2f', m.model, w.workload, t.threshold) AS config_id, m.model, w.workload, t.threshold
FROM (VALUES (0, 'all-MiniLM-L6-v2'), (1, 'modernbert')) m(i, model), (VALUES (0, 'faq'), (1, 'code'), (2, 'chat')) w(i, workload), (VALUES (0, 0.7::DOUBLE), (1, 0.75), (2, 0.8), (3, 0.85), (4, 0.9)) t(i, threshold)""",
    "grid_filter": """SELECT * FROM (SELECT CAST(row_number() OVER (ORDER BY m.i, w.i, t.i) - 1 AS INTEGER) AS position, printf('%s|%s|%.2f', m.model, w.workload, t.threshold) AS config_id, m.model, w.workload, t.threshold
FROM (VALUES (0, 'all-MiniLM-L6-v2'), (1, 'modernbert')) m(i, model), (VALUES (0, 'faq'), (1, 'code'), (2, 'chat')) w(i, workload), (VALUES (0, 0.7::DOUBLE), (1, 0.75), (2, 0.8), (3, 0.85), (4, 0.9)) t(i, threshold))
WHERE model = 'modernbert' AND threshold IN (0.7, 0.9)""",
    "kappa_by_workload": f"""WITH {_PAIRS}, c AS (
  SELECT s.scope, count(*) FILTER (p.original_label = 1 AND p.author_label = 1) AS tp, count(*) FILTER (p.original_label <> 1 AND p.author_label = 1) AS fp, count(*) FILTER (p.original_label = 1 AND p.author_label <> 1) AS fn,
    count(*) FILTER (p.original_label <> 1 AND p.author_label <> 1) AS tn, count(p.author_label) AS n_annotated, count(p.pair_id) - count(p.author_label) AS n_excluded
  FROM (VALUES ('overall'), ('faq'), ('code'), ('chat'), ('none')) s(scope) LEFT JOIN pairs p ON s.scope IN ('overall', p.workload) GROUP BY s.scope)
SELECT scope, tp, fp, fn, tn, n_annotated, n_excluded, round(po, 6) AS observed_agreement, round(pe, 6) AS expected_agreement, round(k, 6) AS kappa FROM ({_kappa("c", "*")})""",
    "kappa_labels_by_lang": f"""WITH c AS (SELECT lang, {_contingency("quality", "toxic")} FROM labels JOIN documents USING (doc_id) GROUP BY lang)
SELECT lang, tp, fp, fn, tn, round(k, 6) AS kappa FROM ({_kappa("c", "*")})""",
    "kappa_strict_gate": f"""WITH {_PAIRS}, filled AS (SELECT workload, pair_id, original_label, coalesce(author_label, CASE WHEN workload = 'faq' THEN NULL ELSE original_label END) AS author_label FROM pairs),
c AS (SELECT s.scope, {_contingency("p.original_label", "p.author_label")} FROM (VALUES ('overall'), ('faq'), ('code'), ('chat')) s(scope) JOIN filled p ON s.scope IN ('overall', p.workload) GROUP BY s.scope)
SELECT scope, n_excluded, round(k, 6) AS kappa, n_excluded = 0 AND coalesce(k < 0.9, true) AS failed FROM ({_kappa("c", "*")})""",
    "stratified_sample": """WITH c AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS workload, CAST(doc_id AS VARCHAR) AS source_pair_id, quality AS label, md5('42:' || doc_id) AS h FROM labels JOIN documents USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY workload, label = 1 ORDER BY h, source_pair_id) AS rank FROM c),
p AS (SELECT workload, source_pair_id, label, row_number() OVER (PARTITION BY workload ORDER BY md5('order:' || h), source_pair_id) - 1 AS position FROM r WHERE rank <= 3)
SELECT workload, printf('%s-%04d', workload, position) AS pair_id, source_pair_id, label, position FROM p""",
    "pair_validation_violations": f"""{_DATASET}
SELECT pair_id, problem FROM (SELECT pair_id, CASE WHEN pair_no % 11 = 1 THEN 'workload' WHEN pair_no % 19 = 4 THEN 'source_pair_id' WHEN pair_no % 13 = 2 THEN 'query_2' WHEN pair_no % 17 = 3 THEN 'original_label' END AS problem FROM dataset) WHERE problem IS NOT NULL""",
    "progress_merge": f"""WITH {_PAIRS}
SELECT pair_id, CAST(coalesce(author_label, label) AS INTEGER) AS author_label, CAST(coalesce(label, author_label) AS INTEGER) AS overwritten FROM (SELECT *, CASE WHEN pair_no % 4 = 0 THEN pair_no % 2 END AS label FROM pairs)""",
    "blind_view": f"""{_DATASET} SELECT pair_id, query_1, query_2 FROM dataset WHERE author_label IS NULL""",
    "annotation_session": f"""WITH {_PAIRS}, a AS (SELECT *, [1, 0, NULL, NULL, 1][CAST((pair_no // 5) % 5 + 1 AS INTEGER)] AS label FROM pairs WHERE author_label IS NULL)
SELECT (SELECT count(*) FROM pairs) AS total_pairs, (SELECT count(author_label) FROM pairs) AS already_labeled, count(label) FILTER (pair_no < 200) AS newly_labeled, count(*) FILTER (pair_no < 200 AND label IS NULL) AS skipped, count(*) FILTER (pair_no = 200) > 0 AS quit_early FROM a""",
    "remaining_pairs": f"""WITH {_PAIRS} SELECT count(*) FILTER (author_label IS NULL) AS remaining FROM pairs""",
    "dataset_roundtrip_csv": f"""{_DATASET} SELECT * EXCLUDE (pair_no) FROM dataset""",
    "dataset_roundtrip_json": f"""{_DATASET} SELECT * EXCLUDE (pair_no) FROM dataset""",
    "last_message_prompt": """SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS prompt FROM conversations GROUP BY conv_id""",
    "request_validation": """SELECT conv_id, CASE WHEN count(*) FILTER (role <> 'system') = 0 THEN 'messages' WHEN count(*) FILTER (role = 'system') > 0 THEN 'threshold' END AS problem, length(arg_max(text, turn) FILTER (role <> 'system')) AS prompt_chars FROM conversations GROUP BY conv_id""",
    # Usage is the number of words of the answer alone.
    "mock_backend_response": """WITH a AS (SELECT conv_id, turn, text, 'Computed response for: ' || reverse(text) AS answer FROM conversations)
SELECT conv_id, turn, answer, len(list_filter(regexp_split_to_array(answer, '\\s+'), lambda w: w <> '')) AS token_usage, 'mock-v1' AS response_model, substr(text, 1, 30) AS shown FROM a""",
    "metrics_snapshot": f"""WITH {_TRAFFIC} SELECT event_type, {_COUNTERS}, round(avg(latency_ms), 4) AS avg_latency_ms, round(100.0 * count(*) FILTER (source <> 'llm') / count(*), 4) AS hit_rate_pct FROM done GROUP BY event_type""",
    "cache_stats_rollup": f"""WITH {_TRAFFIC} SELECT event_type, threshold, CAST(grouping(event_type) AS INTEGER) AS all_event_type, CAST(grouping(threshold) AS INTEGER) AS all_threshold, {_COUNTERS}, round(avg(latency_ms), 4) AS avg_latency_ms,
  round(count(*) FILTER (source <> 'llm') / count(*), 4) AS hit_rate FROM done GROUP BY ROLLUP (event_type, threshold)""",
    "model_breakdown": """WITH d AS (SELECT source, doc_id, text, coalesce(CASE WHEN doc_id % 4 <> 0 THEN lang END, 'unknown') AS name FROM documents),
last AS (SELECT source, text, max(doc_id) AS doc_id FROM d GROUP BY source, text),
kept AS (SELECT doc_id FROM last QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) <= 40),
c AS (SELECT source, name, count(*) FILTER (doc_id IN (SELECT doc_id FROM kept)) AS entries, count(*) FILTER (doc_id % 3 = 0) AS indexed FROM d GROUP BY source, name)
SELECT source, sum(indexed)::BIGINT AS index_size, coalesce(string_agg(name || '=' || entries, ',' ORDER BY name) FILTER (entries > 0), '') AS model_breakdown FROM c GROUP BY source""",
    "clear_report": """SELECT source, count(*) AS exact_entries, count(*) FILTER (doc_id % 3 = 0) AS semantic_entries FROM documents GROUP BY source""",
    "budget_guard": """WITH e AS (SELECT event_id, CAST(round(abs("value") * 100) AS BIGINT) AS cents FROM events), s AS (SELECT *, coalesce(sum(cents) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spent_before FROM e)
SELECT event_id, cents, spent_before, spent_before < 100000 AS sent FROM s""",
    "pool_admission": """WITH r AS (SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'default' ELSE 'm' || (user_id % 20) END AS pool_model, 0.85::DOUBLE AS pool_threshold FROM events),
k AS (SELECT pool_model, dense_rank() OVER (ORDER BY min(event_id)) AS rank FROM r GROUP BY pool_model)
SELECT r.event_id, r.pool_model, r.pool_threshold, k.rank <= 8 AS admitted FROM r JOIN k USING (pool_model)""",
    "response_rows": f"""{_DECIDED}
SELECT 'msg_' || request_id AS id, request_id, CASE WHEN source = 'llm' THEN 'backend' ELSE coalesce(canonical_name, 'asked') END AS model, answer, CASE WHEN source = 'llm' THEN tokens ELSE 0 END AS input_tokens,
  CASE WHEN source = 'llm' THEN tokens * 2 ELSE 0 END AS output_tokens, 'end_turn' AS stop_reason, CASE WHEN source = 'llm' THEN 'MISS' ELSE 'HIT' END AS cache_status, similarity AS cache_similarity FROM decided""",
    "request_log_json": f"""{_DECIDED} SELECT seq, request_id, arrival_ts, completion_ts, 'default' AS embedding_model, threshold, prompt, source AS cache_source, similarity, 12.5::DOUBLE AS latency_ms FROM decided""",
    "log_replay": """WITH f AS (SELECT source, doc_id, min(doc_id) OVER (PARTITION BY source, text) AS first FROM documents)
SELECT source AS source_name, doc_id AS seq, CASE WHEN doc_id > first THEN 'exact_cache' ELSE 'llm' END AS source, CASE WHEN doc_id > first THEN first END AS matched_seq FROM f""",
    "memo_embed_dedupe": """SELECT lang, count(*) AS asked, count(DISTINCT text) AS embedded, 16::BIGINT AS dimension, 1.0::DOUBLE AS norm FROM documents GROUP BY lang""",
    "prompt_features": """SELECT doc_id, sha256(text) AS key, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS tokens, reverse(lang) AS reversed, printf('%s-%04d', lang, doc_id) AS label FROM documents""",
    "duplication_rate": """SELECT source, count(*) AS n, count(DISTINCT text) AS distinct_prompts, round(1 - count(DISTINCT text) / count(*), 6) AS duplication_rate FROM documents GROUP BY source""",
    "threshold_hit_curve": f"""WITH {_NEAREST}, t AS (SELECT CAST(unnest([{_CALIBRATED}]) AS DOUBLE) AS threshold) SELECT threshold, count(*) AS n, count(*) FILTER (1 / (1 + distance) >= threshold) AS hits FROM ranked, t WHERE rank = 1 GROUP BY threshold""",
    "best_threshold": f"""{_swept(_CALIBRATED)}
SELECT model, workload, threshold, round(f0_5, 6) AS f0_5 FROM (SELECT *, row_number() OVER (PARTITION BY model, workload ORDER BY round(f0_5, 9) DESC, threshold) AS r FROM evaluated) WHERE r = 1""",
    "latency_percentiles": f"""WITH {_TRAFFIC} SELECT event_type, round(quantile_cont(latency_ms, 0.5), 6) AS p50, round(quantile_cont(latency_ms, 0.95), 6) AS p95, round(quantile_cont(latency_ms, 0.99), 6) AS p99 FROM traffic GROUP BY event_type""",
    "similarity_histogram": f"""WITH {_NEAREST} SELECT CAST(floor(round(1 / (1 + distance), 9) * 100) AS BIGINT) AS bin, count(*) AS n FROM ranked WHERE rank <= 10 GROUP BY 1""",
    "cost_vs_baseline": f"""WITH {_TRAFFIC} SELECT event_type, round(sum(tokens / 1e6 * 5.0 + tokens * 2 / 1e6 * 25.0), 6) AS baseline_usd, round(coalesce(sum(tokens / 1e6 * 5.0 + tokens * 2 / 1e6 * 25.0) FILTER (source = 'llm'), 0), 6) AS cached_usd FROM done GROUP BY event_type""",
    "two_way_anova": f"""{_swept(_CALIBRATED)},
cell AS (SELECT model, workload, avg(hit_rate) AS cell, count(*) AS n, sum(hit_rate * hit_rate) AS sq FROM evaluated GROUP BY ALL),
m AS (SELECT model, avg(hit_rate) AS by_model FROM evaluated GROUP BY 1), w AS (SELECT workload, avg(hit_rate) AS by_workload FROM evaluated GROUP BY 1), g AS (SELECT avg(hit_rate) AS mean FROM evaluated)
SELECT round(sum(n * (by_model - mean) ** 2), 6) AS ss_model, round(sum(n * (by_workload - mean) ** 2), 6) AS ss_workload, round(sum(n * (cell - by_model - by_workload + mean) ** 2), 6) AS ss_interaction, round(sum(sq - n * cell * cell), 6) AS ss_error
FROM cell JOIN m USING (model) JOIN w USING (workload), g""",
    "session_gaps": """WITH g AS (SELECT event_type, CAST(epoch(date_trunc('second', ts)) - epoch(date_trunc('second', lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id))) AS BIGINT) AS gap FROM events)
SELECT event_type, count(gap) AS n, max(gap) AS longest, count(*) FILTER (gap <= 86400) AS within_day FROM g GROUP BY event_type""",
}
