"""Independent DuckDB SQL for each registered query (the correctness oracle).

The driver registers the Parquet tables as views named after the tables;
every string here runs against those views only.
"""

from __future__ import annotations

from missive.functions import text as T
from missive.plans import sqltext as S
from missive.plans.catalog import CORPUS_TRIGGERS, STOP_TEXT

MESSAGES = """(SELECT d.doc_id, d.text, d.lang, d.source, l.quality, l.toxic,
       CASE WHEN l.quality = 0 THEN 'spam' ELSE 'ham' END AS label
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

MESSAGES_CLEAN = f"""(SELECT * FROM (SELECT m.*, {S.clean_text('m.text')} AS clean_text FROM {MESSAGES} m
  WHERE m.label IS NOT NULL AND m.text IS NOT NULL) WHERE clean_text <> '')"""

TEXTS_BY_SOURCE = """(SELECT 'documents' AS source, text FROM documents
  UNION ALL SELECT 'pages' AS source, html AS text FROM pages)"""


def _label_standardise() -> str:
    word = "' ' || CASE WHEN quality = 0 THEN 'YES' ELSE 'No' END || chr(9)"
    return f"""SELECT doc_id,
  {S.standardise_label('CAST(toxic AS VARCHAR)')} AS toxic_label,
  {S.standardise_label('CAST(CAST(quality AS DOUBLE) AS VARCHAR)')} AS quality_label,
  {S.standardise_label(word)} AS word_label
FROM labels"""


def _dataset_stats() -> str:
    return f"""SELECT spam + ham AS total, spam, ham,
  CASE WHEN spam + ham > 0 THEN round(spam / (spam + ham) * 100.0, 2) ELSE 0.0 END AS spam_percentage
FROM (SELECT count_if(label = 'spam') AS spam, count_if(label = 'ham') AS ham FROM {MESSAGES_CLEAN})"""


def _trigger_hits(triggers) -> str:
    return f"""SELECT source, trigger, count(*) AS hits FROM (
  SELECT source, unnest({S.trigger_matches('text', triggers)}) AS trigger FROM {TEXTS_BY_SOURCE})
GROUP BY source, trigger"""



HISTORY = """(SELECT event_id AS id, props AS email_text, CAST(event_type = 'error' AS INTEGER) AS is_spam,
  value / (value + 1.0) AS probability, value AS confidence, event_type AS model_used,
  CASE WHEN value >= 50.0 THEN 'Word2Vec' ELSE 'TF-IDF' END AS vectorizer_used,
  value * 2.0 AS execution_time_ms, ts AS timestamp FROM events)"""

HISTORY_COLS = "id, email_text, is_spam, probability, confidence, model_used, vectorizer_used, execution_time_ms, timestamp"


def _pct(part: str, total: str) -> str:
    return f"CASE WHEN {total} > 0 THEN round({part} / {total} * 100.0, 2) ELSE 0.0 END"


def _num_text(x: str) -> str:
    return f"CAST(CAST({x} AS DOUBLE) AS VARCHAR)"


RULE_METRICS = """(SELECT 'Marker rule' AS model_name, lang AS vectorizer_name,
  dense_rank() OVER (ORDER BY lang) AS grid_ordinal, tn, fp, fn, tp,
  CASE WHEN tn + fp + fn + tp > 0 THEN (tp + tn) / (tn + fp + fn + tp) ELSE 0.0 END AS accuracy,
  CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall,
  CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1_score
FROM (SELECT lang,
  count_if(label = 'ham' AND y_pred = 'ham') AS tn, count_if(label = 'ham' AND y_pred = 'spam') AS fp,
  count_if(label = 'spam' AND y_pred = 'ham') AS fn, count_if(label = 'spam' AND y_pred = 'spam') AS tp
  FROM (SELECT *, CASE WHEN regexp_matches(text, '[$£€!]') THEN 'spam' ELSE 'ham' END AS y_pred FROM """ + MESSAGES + """)
  GROUP BY lang))"""

PREPARED = f"(SELECT doc_id, label, clean_text FROM {MESSAGES_CLEAN})"

def split_sql(prepared: str) -> str:
    return f"""(WITH p AS {prepared},
counts AS (SELECT label, count(*) AS c FROM p GROUP BY label),
a0 AS (SELECT label, c, sum(c) OVER () AS n, ceil(0.2 * CAST(sum(c) OVER () AS DOUBLE)) AS n_test FROM counts),
a1 AS (SELECT *, CAST(c AS DOUBLE) * CAST(n - n_test AS DOUBLE) / CAST(n AS DOUBLE) AS cont FROM a0),
a2 AS (SELECT *, floor(cont) AS fl, cont - floor(cont) AS rem FROM a1),
a3 AS (SELECT *, (n - n_test) - sum(fl) OVER () AS need, row_number() OVER (ORDER BY rem DESC, label) AS rk FROM a2),
alloc AS (SELECT label, c - (fl + CASE WHEN rk <= need THEN 1 ELSE 0 END) AS n_test_c FROM a3)
SELECT p.doc_id, p.label, p.clean_text,
  CASE WHEN row_number() OVER (PARTITION BY p.label ORDER BY md5('42:' || CAST(p.doc_id AS VARCHAR)), p.doc_id)
       <= alloc.n_test_c THEN 'test' ELSE 'train' END AS split
FROM p JOIN alloc ON p.label = alloc.label)"""


SPLIT = split_sql(PREPARED)
VT = S.vocab_tokens("clean_text")


def terms_sql(split: str) -> str:
    return f"(SELECT doc_id, split, list_concat(toks, {S.bigrams('toks')}) AS terms FROM (SELECT doc_id, split, {VT} AS toks FROM {split}))"


def vocab_sql(split: str) -> str:
    return f"""(WITH t AS {terms_sql(split)},
tr AS (SELECT * FROM t WHERE split = 'train'),
cnt AS (SELECT term, count(*) AS term_count FROM (SELECT unnest(terms) AS term FROM tr) GROUP BY term),
top AS (SELECT * FROM cnt ORDER BY term_count DESC, term ASC LIMIT 5000),
dfq AS (SELECT term, count(*) AS doc_freq FROM (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(terms) AS term FROM tr)) GROUP BY term),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM tr)
SELECT top.term, row_number() OVER (ORDER BY top.term) - 1 AS term_index, top.term_count,
  coalesce(dfq.doc_freq, 0) AS doc_freq, ln((1.0 + n.n) / (1.0 + coalesce(dfq.doc_freq, 0))) + 1.0 AS idf
FROM top LEFT JOIN dfq ON top.term = dfq.term, n)"""


TERMS, VOCAB = terms_sql(SPLIT), vocab_sql(SPLIT)

TFIDF = f"""(WITH t AS {TERMS}, v AS {VOCAB},
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM t) GROUP BY doc_id, term),
w AS (SELECT tf.doc_id, tf.term, (1.0 + ln(tf.tf)) * v.idf AS w FROM tf JOIN v ON tf.term = v.term)
SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w)"""

BATCH = f"""(WITH items AS (SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS id, text, role FROM conversations),
ok AS (SELECT * FROM items WHERE text IS NOT NULL AND length(text) >= 1),
st AS (SELECT *, {S.clean_text('text')} AS clean_text, CAST(length(text) % 101 AS DOUBLE) / 100.0 AS p FROM ok)
SELECT *, CASE WHEN clean_text = '' THEN false ELSE p >= 0.5 END AS is_spam,
  CASE WHEN clean_text = '' THEN 0.0 ELSE round(p, 4) END AS spam_probability,
  CASE WHEN clean_text = '' THEN 100.0 ELSE round(abs(p - 0.5) * 2.0 * 100.0, 2) END AS confidence_score FROM st)"""

TOXIC_LABEL = S.standardise_label("CAST(toxic AS VARCHAR)")

ORACLE: dict[str, str] = {
    "label_standardise": _label_standardise(),
    "clean_text": f"SELECT doc_id, {S.clean_text('text')} AS clean_text FROM documents",
    "html_strip": f"SELECT page_id, {S.clean_text('html')} AS clean_text FROM pages",
    "messages_clean": f"SELECT doc_id, label, clean_text FROM {MESSAGES_CLEAN}",
    "dataset_stats": _dataset_stats(),
    "class_distribution": f"""SELECT 'ham' AS label, ham AS count FROM ({_dataset_stats()})
  UNION ALL SELECT 'spam' AS label, spam AS count FROM ({_dataset_stats()})""",
    "token_counts_by_label": f"""SELECT label, token, count(*) AS n FROM (
  SELECT label, unnest({S.split_clean_text('clean_text')}) AS token FROM {MESSAGES_CLEAN})
GROUP BY label, token""",
    "trigger_hits": _trigger_hits(T.DEFAULT_TRIGGERS),
    "trigger_hits_corpus": _trigger_hits(CORPUS_TRIGGERS),
    "trigger_highlight": f"SELECT page_id, {S.highlight_triggers('html', CORPUS_TRIGGERS)} AS highlighted FROM pages",
    "history_search": f"SELECT {HISTORY_COLS} FROM {HISTORY} WHERE email_text ILIKE '%\"k\": 7%' ORDER BY id DESC LIMIT 100",
    "history_label_filter": f"SELECT {HISTORY_COLS} FROM {HISTORY} WHERE is_spam = 1 ORDER BY id DESC LIMIT 100",
    "history_latest": f"SELECT {HISTORY_COLS} FROM {HISTORY} ORDER BY id DESC LIMIT 100",
    "history_kpis": f"""SELECT count(*) AS total_scans, count_if(is_spam = 1) AS total_spam, count_if(is_spam = 0) AS total_ham,
  {_pct('count_if(is_spam = 1)', 'count(*)')} AS spam_percentage,
  round(coalesce(avg(confidence), 0.0), 2) AS avg_confidence,
  round(coalesce(avg(execution_time_ms), 0.0), 2) AS avg_latency FROM {HISTORY}""",
    "history_append": f"""SELECT CAST(is_spam AS INTEGER) AS is_spam, scans, last_id - scans + 1 AS first_id, last_id, scans AS n_ids, n_texts
FROM (SELECT is_spam, count(*) AS scans, count(DISTINCT email_text) AS n_texts,
        CAST(sum(count(*)) OVER (ORDER BY is_spam DESC) AS BIGINT) AS last_id
      FROM {HISTORY} GROUP BY is_spam)""",
    "history_by_model": f"SELECT model_used, count(*) AS count FROM {HISTORY} GROUP BY model_used",
    "history_trend": f"""SELECT id, is_spam, confidence, timestamp, row_number() OVER (ORDER BY id) AS scan_no,
  CASE WHEN is_spam = 1 THEN 'Spam' ELSE 'Safe (Ham)' END AS label
FROM (SELECT id, is_spam, confidence, timestamp FROM {HISTORY} ORDER BY id LIMIT 50)""",
    "history_windowed_trend": f"""SELECT time_bucket(INTERVAL '1 hour', timestamp) AS window_start,
  time_bucket(INTERVAL '1 hour', timestamp) + INTERVAL '1 hour' AS window_end,
  count(*) AS scans, count_if(is_spam = 1) AS spam_count, round(avg(confidence), 4) AS avg_confidence
FROM {HISTORY} GROUP BY 1, 2""",
    "history_display": f"""SELECT CAST(id AS VARCHAR) AS id, strftime(timestamp, '%b %d, %Y - %H:%M:%S') AS scanned_at, email_text,
  CASE WHEN is_spam = 1 THEN 'Spam 🚨' ELSE 'Safe ✅' END AS spam_prediction,
  {_num_text('round(probability * 100.0, 1)')} || '%' AS probability,
  {_num_text('confidence')} || '%' AS confidence, model_used,
  {_num_text('execution_time_ms')} || ' ms' AS execution_time FROM {HISTORY}""",
    "confusion_matrix": f"""SELECT vectorizer_name, tn, fp, fn, tp,
  '[[' || tn || ',' || fp || '],[' || fn || ',' || tp || ']]' AS matrix FROM {RULE_METRICS}""",
    "eval_metrics": f"SELECT model_name, vectorizer_name, accuracy, precision, recall, f1_score FROM {RULE_METRICS}",
    "best_model": f"SELECT model_name, vectorizer_name, f1_score FROM {RULE_METRICS} ORDER BY f1_score DESC, grid_ordinal LIMIT 1",
    "metrics_unpivot": " UNION ALL ".join(
        f"""SELECT model_name, vectorizer_name, '{m}' AS metric, {m} AS score,
  model_name || ' (' || vectorizer_name || ')' AS model_node, {m} * 100.0 AS score_pct FROM {RULE_METRICS}"""
        for m in ("accuracy", "precision", "recall", "f1_score")),
    "metrics_table": "SELECT model_name, vectorizer_name, " + ", ".join(
        f"{_num_text(f'round({m} * 100.0, 2)')} || '%' AS {m}" for m in ("accuracy", "precision", "recall", "f1_score"))
        + f" FROM {RULE_METRICS}",
    "stratified_split_members": f"SELECT doc_id, label, split FROM {SPLIT}",
    "stratified_split_counts": f"SELECT label, split, count(*) AS n FROM {SPLIT} GROUP BY label, split",
    "class_weights": f"""SELECT label, n_c, round(CAST(sum(n_c) OVER () AS DOUBLE) / CAST(count(*) OVER () * n_c AS DOUBLE), 9) AS weight
FROM (SELECT label, count(*) AS n_c FROM {SPLIT} WHERE split = 'train' GROUP BY label)""",
    "tfidf_vocab": f"SELECT term, term_index, term_count, doc_freq, round(idf, 9) AS idf FROM {VOCAB}",
    "tfidf_weights": f"SELECT doc_id, term, round(weight, 6) AS weight FROM {TFIDF}",
    "bigrams_topk": f"""SELECT bigram, count(*) AS n FROM (SELECT unnest({S.bigrams(S.vocab_tokens('clean_text'))}) AS bigram
  FROM {PREPARED}) GROUP BY bigram ORDER BY n DESC, bigram ASC LIMIT 100""",
    "bigram_counts": f"""SELECT bigram, count(*) AS n FROM (
  SELECT unnest({S.bigrams(S.vocab_tokens('clean_text'))}) AS bigram FROM {PREPARED}) GROUP BY bigram""",
    "embedding_mean": """SELECT label, dim, round(avg(CAST(x AS DOUBLE)), 6) AS mean_value FROM (
  SELECT label, unnest(generate_series(0, len(embedding) - 1)) AS dim, unnest(embedding) AS x FROM embeddings)
GROUP BY label, dim""",
    "score_postprocess": f"SELECT id, is_spam, spam_probability, confidence_score FROM {BATCH}",
    "batch_summary": f"""SELECT role, count(*) AS total_processed, count_if(is_spam) AS spam_count,
  count(*) - count_if(is_spam) AS ham_count, {_pct('count_if(is_spam)', 'count(*)')} AS spam_percentage
FROM {BATCH} GROUP BY role""",
    "batch_display": f"""SELECT id, CASE WHEN is_spam THEN 'Spam 🚨' ELSE 'Safe (Ham) ✅' END AS prediction,
  {_num_text('round(spam_probability * 100.0, 1)')} || '%' AS probability_pct,
  {_num_text('confidence_score')} || '%' AS confidence_pct FROM {BATCH}""",
    "ingest_roundtrip": f"SELECT label, text FROM {MESSAGES} WHERE text IS NOT NULL",
    "pool_append": f"""SELECT label, text FROM (SELECT label, text FROM {MESSAGES}
  UNION ALL SELECT {TOXIC_LABEL} AS label, text FROM {MESSAGES} WHERE {TOXIC_LABEL} IN ('spam', 'ham'))
WHERE label IS NOT NULL AND text IS NOT NULL""",
}

def _lemmatize() -> str:
    from missive.functions.lemma import NOUN_RULES
    stems = ", ".join(
        f"CASE WHEN suffix(tok, '{o}') AND length(tok) - {len(o)} > 0 THEN left(tok, length(tok) - {len(o)}) || '{n}' END"
        for o, n in NOUN_RULES)
    return f"""WITH m AS (SELECT doc_id, {S.clean_tokens('text')} AS toks FROM {MESSAGES} WHERE label IS NOT NULL AND text IS NOT NULL),
lex AS (SELECT tok AS lemma FROM (SELECT DISTINCT doc_id, unnest(toks) AS tok FROM m) GROUP BY tok HAVING count(*) >= 2),
d AS (SELECT DISTINCT unnest(toks) AS tok FROM m),
c AS (SELECT tok, unnest(list_filter([tok, {stems}], lambda x: x IS NOT NULL)) AS cand FROM d),
k AS (SELECT c.tok, c.cand, row_number() OVER (PARTITION BY c.tok ORDER BY length(c.cand), c.cand) AS rk
      FROM c JOIN lex ON c.cand = lex.lemma),
lm AS (SELECT d.tok, coalesce(k.cand, d.tok) AS lemma FROM d LEFT JOIN k ON d.tok = k.tok AND k.rk = 1),
e AS (SELECT doc_id, unnest(toks) AS tok, unnest(generate_series(1, len(toks))) AS pos FROM m)
SELECT m.doc_id, coalesce(x.lemma_text, '') AS lemma_text FROM m LEFT JOIN (
  SELECT e.doc_id, string_agg(lm.lemma, ' ' ORDER BY e.pos) AS lemma_text FROM e JOIN lm ON e.tok = lm.tok GROUP BY e.doc_id
) x ON m.doc_id = x.doc_id"""


ORACLE["lemmatize"] = _lemmatize()
ORACLE["stream_kpis"] = ORACLE["history_kpis"]
ORACLE["stream_trend"] = ORACLE["history_windowed_trend"]
ORACLE["messages_lemmatised"] = f"""SELECT l.doc_id, m.label, l.lemma_text AS clean_text
FROM ({ORACLE["lemmatize"]}) l JOIN {MESSAGES} m ON l.doc_id = m.doc_id WHERE l.lemma_text <> ''"""


# --- naive Bayes on TF-IDF in closed form -----------------------------------

def _weights(rows: str) -> str:
    """L2-normalised TF-IDF weights (key, term, x) of rows (key, clean_text) over the vocabulary ``v``."""
    return f"""(SELECT key, term, w / sqrt(sum(w * w) OVER (PARTITION BY key)) AS x FROM (
  SELECT t.key, t.term, (1.0 + ln(t.tf)) * v.idf AS w FROM (
    SELECT key, term, count(*) AS tf FROM (
      SELECT key, unnest(list_concat(toks, {S.bigrams('toks')})) AS term FROM (SELECT key, {VT} AS toks FROM {rows}))
    GROUP BY key, term) t JOIN v ON t.term = v.term))"""


def naive_bayes(prepared: str, items: str) -> str:
    """Scores (key, is_spam, spam_probability, confidence_score) of ``items`` (key, clean_text; ``s`` is the split)."""
    return f"""(WITH s AS MATERIALIZED {split_sql(prepared)},
v AS MATERIALIZED {vocab_sql('s')},
tr AS (SELECT doc_id AS key, label, clean_text FROM s WHERE split = 'train'),
classes AS (SELECT label, ln(count(*) + 1.0) - ln(sum(count(*)) OVER () + 2.0) AS prior FROM tr GROUP BY label),
mass AS (SELECT tr.label, x.term, sum(x.x) AS m FROM {_weights('tr')} x JOIN tr ON x.key = tr.key GROUP BY tr.label, x.term),
total AS (SELECT label, sum(m) + (SELECT count(*) FROM v) AS m FROM mass GROUP BY label),
theta AS (SELECT total.label, v.term, ln(coalesce(mass.m, 0.0) + 1.0) - ln(total.m) AS lp
  FROM total CROSS JOIN v LEFT JOIN mass ON mass.label = total.label AND mass.term = v.term),
items AS MATERIALIZED {items},
fit AS (SELECT x.key, theta.label, sum(x.x * theta.lp) AS ll FROM {_weights('items')} x JOIN theta ON x.term = theta.term
  GROUP BY x.key, theta.label),
odds AS (SELECT i.key, i.clean_text,
    sum(CASE WHEN c.label = 'ham' THEN 1.0 ELSE -1.0 END * (c.prior + coalesce(fit.ll, 0.0))) AS d
  FROM items i CROSS JOIN classes c LEFT JOIN fit ON fit.key = i.key AND fit.label = c.label GROUP BY i.key, i.clean_text),
p AS (SELECT key, clean_text, 1.0 / (1.0 + exp(d)) AS p FROM odds)
SELECT key, clean_text, CASE WHEN clean_text = '' THEN false ELSE p >= 0.5 END AS is_spam,
  CASE WHEN clean_text = '' THEN 0.0 ELSE round(p, 4) END AS spam_probability,
  CASE WHEN clean_text = '' THEN 100.0 ELSE round(abs(p - 0.5) * 2.0 * 100.0, 2) END AS confidence_score FROM p)"""


TURNS = f"(SELECT DISTINCT text AS key, {S.clean_text('text')} AS clean_text FROM conversations WHERE length(text) >= 1)"
LEMMATISED = f"({ORACLE['messages_lemmatised']})"

ORACLE["train_score_nb_tfidf"] = f"""SELECT n.key AS doc_id, m.label, CASE WHEN n.is_spam THEN 'spam' ELSE 'ham' END AS y_pred,
  n.is_spam, n.spam_probability, n.confidence_score
FROM {naive_bayes(PREPARED, "(SELECT doc_id AS key, clean_text FROM s WHERE split = 'test')")} n JOIN {MESSAGES} m ON n.key = m.doc_id"""
ORACLE["batch_analysis"] = f"""SELECT CAST(c.conv_id AS VARCHAR) || ':' || CAST(c.turn AS VARCHAR) AS id, n.is_spam, n.spam_probability,
  n.confidence_score, 'Naive Bayes' AS model_name, count(*) OVER (PARTITION BY c.text) AS n_stored,
  n.spam_probability AS stored_probability
FROM conversations c JOIN {naive_bayes(PREPARED, TURNS)} n ON c.text = n.key"""
ORACLE["stream_score_nb"] = f"""SELECT c.text AS email_text, CAST(n.is_spam AS INTEGER) AS is_spam, n.spam_probability AS probability,
  n.confidence_score AS confidence, 'Naive Bayes' AS model_used, count(*) AS n
FROM conversations c JOIN {naive_bayes(PREPARED, TURNS)} n ON c.text = n.key GROUP BY ALL"""
ORACLE["score_lemmatised"] = f"""SELECT key AS doc_id, clean_text, is_spam, spam_probability, confidence_score
FROM {naive_bayes(LEMMATISED, f"(SELECT doc_id AS key, lemma_text AS clean_text FROM ({ORACLE['lemmatize']}))")}"""
ORACLE["model_registry"] = f"""SELECT g.model_name, g.vectorizer_name, g.grid_ordinal, t.ham_tested, t.spam_tested, true AS consistent
FROM (SELECT m.name AS model_name, f.name AS vectorizer_name, CAST(f.i * 4 + m.i + 1 AS BIGINT) AS grid_ordinal
      FROM (VALUES ('TF-IDF', 0), ('Word2Vec', 1)) f(name, i)
      CROSS JOIN (VALUES ('Logistic Regression', 0), ('Naive Bayes', 1), ('Support Vector Machine', 2), ('Random Forest', 3)) m(name, i)) g
CROSS JOIN (SELECT count_if(label = 'ham') AS ham_tested, count_if(label = 'spam') AS spam_tested
            FROM {SPLIT} WHERE split = 'test') t"""
ORACLE["pool_versions"] = f"""SELECT label, text, CAST((SELECT count(*) FROM {MESSAGES} WHERE {TOXIC_LABEL} IN ('spam', 'ham')) AS BIGINT) AS uploaded,
  count(*) OVER () AS total, CAST(2 AS BIGINT) AS version FROM ({ORACLE['pool_append']})"""
ORACLE["ingest_headered"] = f"""SELECT * FROM (
  SELECT CASE doc_id % 4 WHEN 0 THEN 'spam' WHEN 1 THEN 'ham' WHEN 3 THEN 'spam' END AS label,
    't ' || regexp_replace(CASE WHEN doc_id % 5 = 0 THEN coalesce(text, '') ELSE replace(coalesce(text, ''), ',', ';') END, '["\\\\\\r\\n\\t]', ' ', 'g') AS text FROM {MESSAGES})
WHERE label IS NOT NULL AND NOT contains(text, ',')"""
ORACLE["processed_reread"] = f"""SELECT label, text, clean_text FROM {MESSAGES_CLEAN} WHERE doc_id % 7 NOT IN (0, 1)"""
ORACLE["batch_file"] = """SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS id,
  turn % 5 NOT IN (3, 4) AND length(coalesce(text, '')) >= 1 AS accepted,
  CASE WHEN turn % 5 IN (3, 4) THEN '' ELSE coalesce(text, '') END AS text FROM conversations"""
ORACLE["ingest_quoted"] = """SELECT CASE page_id % 3 WHEN 0 THEN 'spam' ELSE 'ham' END AS label,
  '"' || coalesce(url, '') || '",' || chr(10) || chr(10) || '"' || coalesce(html, '') || '"' || chr(10) AS text
FROM pages WHERE page_id % 3 IN (0, 1)"""
ORACLE["learner_optimality"] = f"""WITH s AS MATERIALIZED {SPLIT}, v AS MATERIALIZED {vocab_sql("s")}
SELECT 'Logistic Regression' AS learner, (SELECT count(*) FROM s WHERE split = 'train') AS n_rows, (SELECT count(*) FROM v) AS n_terms, true AS optimal
UNION ALL SELECT 'Platt scaling', (SELECT count(*) FROM s WHERE split = 'train'), 1, true"""


# --- Gaussian naive Bayes on stored word vectors, in closed form -------------

ORACLE["gaussian_nb_vectors"] = """WITH msg AS (
  SELECT o_orderkey AS doc_id, CASE WHEN o_orderstatus = 'F' THEN 'spam' ELSE 'ham' END AS label
  FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
known AS (SELECT l.l_orderkey AS doc_id, e.embedding FROM lineitem l JOIN embeddings e ON l.l_partkey = e.vec_id),
pooled AS (SELECT doc_id, i, avg(embedding[i]::DOUBLE) AS x FROM known, range(1, 65) t(i) GROUP BY doc_id, i),
xs AS MATERIALIZED (SELECT m.doc_id, m.label, t.i, coalesce(p.x, 0.0) AS x
  FROM msg m CROSS JOIN range(1, 65) t(i) LEFT JOIN pooled p ON p.doc_id = m.doc_id AND p.i = t.i),
eps AS (SELECT max(v) * 1e-9 AS e FROM (SELECT var_pop(x) AS v FROM xs GROUP BY i)),
fit AS (SELECT label, i, avg(x) AS mean, avg(x * x) - avg(x) * avg(x) + (SELECT e FROM eps) AS var FROM xs GROUP BY label, i),
prior AS (SELECT label, ln(count(*)::DOUBLE) AS lp FROM msg GROUP BY label),
ll AS (SELECT xs.doc_id, fit.label AS class, -0.5 * sum((xs.x - fit.mean) * (xs.x - fit.mean) / fit.var + ln(fit.var)) AS l
  FROM xs JOIN fit ON xs.i = fit.i GROUP BY xs.doc_id, fit.label),
odds AS (SELECT ll.doc_id, sum(CASE WHEN class = 'ham' THEN l + lp ELSE -(l + lp) END) AS d FROM ll JOIN prior ON ll.class = prior.label GROUP BY ll.doc_id)
SELECT m.doc_id, m.label, 1.0 / (1.0 + exp(d)) >= 0.5 AS is_spam, round(1.0 / (1.0 + exp(d)), 4) AS spam_probability
FROM msg m JOIN odds ON m.doc_id = odds.doc_id"""


# --- word pairs --------------------------------------------------------------

ORACLE["word_pairs"] = f"""WITH w AS (
  SELECT row_number() OVER () AS r, {S.split_clean_text('clean_text')} AS ws FROM {SPLIT} WHERE split = 'train'),
t AS (SELECT r, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS at FROM w)
SELECT x.word AS a, y.word AS b, count(*) AS n FROM t x JOIN t y ON x.r = y.r AND x.at <> y.at AND abs(x.at - y.at) <= 5 GROUP BY 1, 2"""
ORACLE["word_ppmi"] = f"""WITH p AS MATERIALIZED ({ORACLE['word_pairs']}),
s AS (SELECT a, sum(n) AS n FROM p GROUP BY a)
SELECT p.a, p.b, round(ln(p.n * (SELECT sum(n) FROM s)::DOUBLE / (x.n::DOUBLE * y.n)), 6) AS weight
FROM p JOIN s x ON p.a = x.a JOIN s y ON p.b = y.a WHERE ln(p.n * (SELECT sum(n) FROM s)::DOUBLE / (x.n::DOUBLE * y.n)) > 0"""
ORACLE["word_vectors"] = f"""SELECT DISTINCT a AS word, CAST(100 AS INTEGER) AS size, true AS not_zero, true AS finite FROM ({ORACLE['word_ppmi']})"""


# --- rows with gaps ------------------------------------------------------------

ORACLE["messages_gaps"] = f"""SELECT doc_id, label, clean_text FROM {MESSAGES_CLEAN} WHERE doc_id % 5 NOT IN (0, 1, 2)"""
ORACLE["score_blank"] = f"""WITH t AS (SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS id,
  CASE WHEN turn % 3 = 1 THEN {S.lit(STOP_TEXT)} ELSE text END AS text FROM conversations),
c AS (SELECT id, {S.clean_text('text')} AS clean_text, (length(text) % 101) / 100.0 AS p FROM t WHERE length(text) >= 1)
SELECT id, clean_text, clean_text <> '' AND p >= 0.5 AS is_spam, CASE WHEN clean_text = '' THEN 0.0 ELSE round(p, 4) END AS spam_probability,
  CASE WHEN clean_text = '' THEN 100.0 ELSE round(abs(p - 0.5) * 2.0 * 100.0, 2) END AS confidence_score FROM c"""
ORACLE["ingest_ragged"] = f"""SELECT label, CASE WHEN doc_id % 3 = 2 THEN
  't ' || regexp_replace(coalesce(text, ''), '["\\\\\\r\\n\\t]', ' ', 'g') END AS text FROM {MESSAGES} WHERE doc_id % 3 <> 1"""
ORACLE["batch_row_numbers"] = """SELECT count(*) AS n, count(*) AS n_ids, CAST(1 AS BIGINT) AS first_id, count(*) AS last_id, CAST(0 AS BIGINT) AS n_odd,
  CAST(sum(length(text)) AS BIGINT) AS text_chars, count(DISTINCT text) AS n_texts FROM conversations"""
ORACLE["history_kpis_merged"] = f"""SELECT * FROM ({ORACLE['history_kpis']}), ({ORACLE['history_by_model']})"""


# --- stores and modes ------------------------------------------------------------

ORACLE["processed_versions"] = f"""SELECT * FROM (SELECT label, text, {S.clean_text('text')} AS clean_text,
  (SELECT count(*) FROM {MESSAGES_CLEAN}) AS rows_before FROM ({ORACLE['pool_append']})) WHERE clean_text <> ''"""
ORACLE["history_clear"] = f"""SELECT CAST(0 AS INTEGER) AS is_spam, count(*) AS scans, CAST(1 AS BIGINT) AS first_id, count(*) AS last_id,
  count(*) AS n_ids, count(DISTINCT email_text) AS n_texts FROM {HISTORY} WHERE is_spam = 0"""
ORACLE["ingest_modes"] = f"""SELECT m.label, 't ' || regexp_replace(coalesce(m.text, ''), '["\\\\\\r\\n\\t]', ' ', 'g') AS text, k.mode
FROM {MESSAGES} m CROSS JOIN (VALUES ('headered'), ('headerless')) k(mode)"""
