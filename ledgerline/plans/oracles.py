"""The same results in plain SQL, written without the engine, for comparison.

Statement queries are compared with the rows that the statements were rendered from.
"""

from __future__ import annotations

ORACLES: dict[str, str] = {}

TX = """
  SELECT o_orderkey AS id,
    concat('usr_', cast(o_custkey % 20 AS varchar)) AS owner_id,
    CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE concat('acct-', cast(o_custkey AS varchar)) END
      AS account_id,
    n_name AS bank_name, cast(o_orderdate AS date) AS date,
    CASE n_regionkey WHEN 0 THEN 'USD' WHEN 1 THEN 'THB' WHEN 2 THEN 'EUR' WHEN 3 THEN 'CAD'
      ELSE 'GBP' END AS currency_iso_code,
    cast(round(o_totalprice, 2) AS decimal(38,2)) AS amount,
    CASE WHEN o_orderstatus = 'F' THEN 'DEBIT' ELSE 'CREDIT' END AS type,
    concat(c_mktsegment, ' payment ', o_orderpriority, ' REF ',
      cast(o_orderkey % 1000 AS varchar)) AS description,
    o_orderdate AS created_at,
    CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END AS updated_at,
    o_orderkey % 11 = 0 AS deleted
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""

INCOMING = """
  SELECT owner_id, concat('batch-', owner_id) AS batch_id, id * 4 + copy AS row_pos, id, copy, date,
    amount, type, bank_name, currency_iso_code, account_id, (id + copy) % 13 = 0 AS allow_duplicate,
    CASE (id + copy) % 5 WHEN 0 THEN lower(replace(description, ' ', '-'))
      WHEN 1 THEN replace(description, 'payment', 'paymet')
      WHEN 2 THEN replace(description, 'REF ', 'REF 9')
      WHEN 3 THEN concat('unrelated merchant ', cast(copy AS varchar))
      ELSE description END AS description
  FROM tx CROSS JOIN (VALUES (0), (1), (2), (3)) c(copy) WHERE copy - id % 3 IN (0, 1)"""

BASE = f"WITH tx AS ({TX}), act AS (SELECT * FROM tx WHERE NOT deleted)"
TS = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {0}"
PUBLIC = (
    "id, owner_id, account_id, bank_name, cast(date AS varchar) AS date, currency_iso_code, "
    f"cast(amount AS double) AS amount, type, description, {TS.format('created_at')}, "
    f"{TS.format('updated_at')}"
)


def norm(c: str) -> str:
    """ASCII form of the normalized description."""
    return f"regexp_replace(upper({c}), '[^A-Z0-9]', '', 'g')"


def toks(c: str) -> str:
    return f"array_to_string(regexp_extract_all({c}, '[0-9]+'), ' ')"


def match(na: str, ta: str, nb: str, tb: str) -> str:
    return (
        f"({na} = {nb} OR ({ta} = {tb} AND length({na}) >= 8 AND length({nb}) >= 8 AND "
        f"1.0 - levenshtein({na}, {nb})::double / greatest(length({na}), length({nb})) >= 0.90))"
    )


ORACLES["criteria_search"] = f"""{BASE} SELECT {PUBLIC} FROM act
  WHERE lower(bank_name) LIKE '%nation!_1%' ESCAPE '!'
    AND date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'
    AND amount BETWEEN 50000.00 AND 400000.00 AND type = 'CREDIT'
    AND (contains(lower(description), 'building') OR contains(lower(description), 'household'))
    AND (contains(lower(description), 'urgent') OR contains(lower(description), 'low'))"""

ORACLES["search_page"] = f"""{BASE}, hit AS (
    SELECT * FROM act WHERE contains(lower(bank_name), 'nation_2')
    ORDER BY date DESC, id DESC LIMIT 40 OFFSET 80)
  SELECT {PUBLIC} FROM hit"""

ORACLES["search_page_meta"] = f"""{BASE}, t AS (
    SELECT count(*) AS n FROM act WHERE contains(lower(bank_name), 'nation_2'))
  SELECT 2 AS page, 40 AS size, greatest(0, least(40, n - 80)) AS number_of_elements,
    n AS total_elements, cast(ceil(n / 40.0) AS bigint) AS total_pages, false AS "first",
    3 >= ceil(n / 40.0) AS "last" FROM t"""

ORACLES["search_after"] = f"""{BASE} SELECT id, cast(date AS varchar) AS date FROM act
  WHERE date < DATE '1999-06-01' OR (date = DATE '1999-06-01' AND id < 5000)
  ORDER BY act.date DESC, id DESC LIMIT 100"""

DEEP = f"""{BASE}, ranked AS (SELECT *, count(*) OVER () AS n,
    row_number() OVER (ORDER BY description, updated_at DESC NULLS FIRST, id) - 1 AS r FROM act WHERE type = 'DEBIT')"""

ORACLES["deep_page"] = f"""{DEEP} SELECT id, description, {TS.format('updated_at')} FROM ranked
  WHERE r // 40 = n // 80"""

ORACLES["deep_page_meta"] = f"""{DEEP}, t AS (SELECT count(*) AS n FROM ranked)
  SELECT n // 80 AS page, 40 AS size, least(40, n - n // 80 * 40) AS number_of_elements,
    n AS total_elements, cast(ceil(n / 40.0) AS bigint) AS total_pages, n < 80 AS "first",
    n // 80 + 1 >= ceil(n / 40.0) AS "last" FROM t"""

ORACLES["null_order_sort"] = f"""{BASE}, hit AS (
    SELECT * FROM act ORDER BY updated_at DESC NULLS FIRST, id LIMIT 100)
  SELECT id, owner_id, {TS.format('updated_at')} FROM hit"""

ORACLES["account_order_sort"] = f"""{BASE}, hit AS (
    SELECT * FROM act ORDER BY account_id ASC NULLS LAST, amount DESC, id LIMIT 100)
  SELECT id, account_id, cast(amount AS double) AS amount FROM hit"""

ORACLES["count_by_owner"] = f"""{BASE} SELECT owner_id, count(*) AS n FROM act
  WHERE amount >= 1000.00 AND date <= DATE '2000-01-01' GROUP BY owner_id"""

ORACLES["count_matching"] = f"""{BASE} SELECT count(*) AS n FROM act
  WHERE contains(lower(description), 'automobile') AND type = 'DEBIT' AND owner_id = 'usr_3'"""

ORACLES["text_words_or"] = f"""{BASE} SELECT id, description FROM act
  WHERE (contains(lower(description), 'automobile') OR contains(lower(description), 'urgent'))
    AND (contains(lower(description), 'ref') OR contains(lower(description), '77'))"""

ORACLES["wildcard_literal"] = f"""{BASE},
  w(word) AS (VALUES ('nation_1'), ('nation%1'), ('n_tion'), ('%'), ('_'), ('NATION\\'))
  SELECT word, count(*) AS n, sum(id)::bigint AS ids
  FROM act JOIN w ON contains(lower(bank_name), lower(word)) GROUP BY word"""

ORACLES["account_bank_sets"] = f"""{BASE} SELECT id, account_id, bank_name FROM act
  WHERE (contains(lower(account_id), 'acct-12') OR contains(lower(account_id), 'acct-9')
      OR contains(lower(account_id), 'acct-101'))
    AND (contains(lower(bank_name), 'nation_2') OR contains(bank_name, '3')
      OR contains(bank_name, '4'))"""

ORACLES["currency_in"] = f"""{BASE} SELECT currency_iso_code, count(*) AS n,
    cast(sum(amount) AS double) AS total FROM act
  WHERE lower(currency_iso_code) IN ('usd', 'thb') GROUP BY 1"""

ORACLES["timestamp_ranges"] = f"""{BASE} SELECT id, {TS.format('created_at')},
    {TS.format('updated_at')} FROM act
  WHERE act.created_at BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1999-12-31'
    AND act.updated_at BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1999-06-30'"""

ORACLES["owner_list"] = f"""{BASE} SELECT id, owner_id, cast(amount AS double) AS amount FROM act
  WHERE owner_id = 'usr_7'"""

ORACLES["actor_scope"] = f"""{BASE}
  SELECT 'own' AS scope, count(*) AS n, sum(id)::bigint AS ids FROM act WHERE owner_id = 'usr_4'
  UNION ALL SELECT 'any', count(*), sum(id)::bigint FROM act"""

ORACLES["normalize_description"] = """SELECT doc_id,
    md5(regexp_replace(upper(nfkd), '[^\\p{L}\\p{Nd}]', '', 'g')) AS digest
  FROM (SELECT doc_id, strip_accents(replace(text, 'ß', 'ss')) AS nfkd FROM documents)"""

ORACLES["numeric_tokens"] = """SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS digest
  FROM (SELECT doc_id, regexp_extract_all(text, '\\p{Nd}+') AS t FROM documents)"""

PAIRS = f"""{BASE}, inc AS ({INCOMING}), pairs AS (
    SELECT inc.row_pos, {norm('inc.description')} AS a, {norm('tx.description')} AS b,
      {toks('inc.description')} AS ta, {toks('tx.description')} AS tb
    FROM inc JOIN tx ON inc.id = tx.id)"""

ORACLES["similarity"] = f"""{PAIRS} SELECT row_pos, levenshtein(a, b) AS distance,
    round(1.0 - levenshtein(a, b)::double / greatest(length(a), length(b)), 9) AS similarity
  FROM pairs"""

ORACLES["descriptions_match"] = f"""{PAIRS}
  SELECT row_pos, {match('a', 'ta', 'b', 'tb')} AS matched FROM pairs"""

# "123.45." is no number for either reading.
ORACLES["statement_amounts"] = """SELECT o_orderkey AS id,
    CASE WHEN o_orderkey % 5 < 4 THEN round(o_totalprice, 2) END AS csv_amount,
    CASE WHEN o_orderkey % 5 IN (0, 1) THEN -round(o_totalprice, 2)
      WHEN o_orderkey % 5 < 4 THEN round(o_totalprice, 2) END AS signed_amount
  FROM orders"""

ORACLES["canonical_amounts"] = """SELECT l_returnflag, cast(sum(cast(
      round(cast(l_extendedprice AS decimal(14,2)) * cast(l_discount AS decimal(4,2)), 2)
      AS decimal(38,2))) AS double) AS rounded
  FROM lineitem GROUP BY l_returnflag"""

ORACLES["statement_dates"] = """SELECT id,
    CASE WHEN d <= 31 THEN cast(make_date(
        CASE WHEN v = 0 THEN 2000 + y % 100 ELSE y END, m,
        least(d, day(last_day(make_date(CASE WHEN v = 0 THEN 2000 + y % 100 ELSE y END, m, 1)))))
      AS varchar) END AS date
  FROM (SELECT o_orderkey AS id, year(o_orderdate) AS y, month(o_orderdate) AS m,
    29 + o_orderkey % 4 AS d, o_orderkey % 4 AS v FROM orders)"""

KEY = "owner_id, bank_name, date, amount, type, currency_iso_code"
KEYQ = ["owner_id", "bank_name", "date", "amount", "type", "currency_iso_code"]


def same_key(a: str, b: str) -> str:
    return " AND ".join(f"{a}.{k} = {b}.{k}" for k in KEYQ)


ORACLES["duplicate_candidates"] = f"""{BASE}, inc AS ({INCOMING}),
  keys AS (SELECT DISTINCT {KEY} FROM inc)
  SELECT act.owner_id, act.bank_name, cast(act.date AS varchar) AS date,
    cast(act.amount AS double) AS amount, act.type, act.currency_iso_code,
    act.id AS transaction_id, act.description
  FROM act JOIN keys ON {same_key('act', 'keys')}"""

ORACLES["candidate_groups"] = f"""{BASE}, inc AS ({INCOMING}),
  keys AS (SELECT DISTINCT {KEY} FROM inc)
  SELECT act.owner_id, act.bank_name, cast(act.date AS varchar) AS date,
    cast(act.amount AS double) AS amount, act.type, act.currency_iso_code, count(*) AS candidates
  FROM act JOIN keys ON {same_key('act', 'keys')} GROUP BY ALL"""

PREP = f"""{BASE}, inc0 AS ({INCOMING}),
  inc AS (SELECT *, {norm('description')} AS norm, {toks('description')} AS toks FROM inc0),
  st AS (SELECT *, {norm('description')} AS norm, {toks('description')} AS toks FROM act),
  ext AS (SELECT DISTINCT i.row_pos FROM inc i JOIN st s ON {same_key('i', 's')}
    AND {match('i.norm', 'i.toks', 's.norm', 's.toks')})"""

ORACLES["preview_marking"] = f"""{PREP},
  bat AS (SELECT DISTINCT i.row_pos FROM inc i JOIN inc j ON {same_key('i', 'j')}
    AND j.row_pos < i.row_pos AND {match('i.norm', 'i.toks', 'j.norm', 'j.toks')})
  SELECT inc.owner_id, inc.row_pos, ext.row_pos IS NOT NULL OR bat.row_pos IS NOT NULL AS duplicate,
    CASE WHEN ext.row_pos IS NOT NULL THEN 'EXISTING_TRANSACTION'
      WHEN bat.row_pos IS NOT NULL THEN 'IN_BATCH' END AS duplicate_reason
  FROM inc LEFT JOIN ext ON inc.row_pos = ext.row_pos LEFT JOIN bat ON inc.row_pos = bat.row_pos"""

# A key's rows are walked in order by a recursive query; ``seen`` holds the accepted positions.
ACCEPT = f"""{PREP.replace('WITH tx', 'WITH RECURSIVE tx', 1)},
  num AS (SELECT inc.*, ext.row_pos IS NOT NULL AS in_store,
    row_number() OVER (PARTITION BY {KEY} ORDER BY inc.row_pos) AS rn,
    dense_rank() OVER (ORDER BY {KEY}) AS g
    FROM inc LEFT JOIN ext ON inc.row_pos = ext.row_pos),
  walk AS (
    SELECT g, rn, row_pos, owner_id,
      CASE WHEN in_store AND NOT allow_duplicate THEN 'SKIP' WHEN in_store THEN 'DUPIMP'
        ELSE 'NEW' END AS outcome,
      CASE WHEN in_store AND NOT allow_duplicate
        THEN []::struct(n varchar, t varchar)[]
        ELSE [{{'n': norm, 't': toks}}]::struct(n varchar, t varchar)[] END AS seen
    FROM num WHERE rn = 1
    UNION ALL
    SELECT g, rn, row_pos, owner_id,
      CASE WHEN dup AND NOT allow_duplicate THEN 'SKIP' WHEN dup THEN 'DUPIMP' ELSE 'NEW' END,
      CASE WHEN dup AND NOT allow_duplicate THEN seen
        ELSE list_append(seen, {{'n': norm, 't': toks}}) END
    FROM (SELECT n.g, n.rn, n.row_pos, n.owner_id, n.allow_duplicate, n.norm, n.toks, w.seen,
        n.in_store OR len(list_filter(w.seen, lambda x:
          {match('x.n', 'x.t', 'n.norm', 'n.toks')})) > 0 AS dup
      FROM walk w JOIN num n ON n.g = w.g AND n.rn = w.rn + 1)
  )"""

ORACLES["batch_accept"] = f"{ACCEPT} SELECT owner_id, row_pos, outcome FROM walk"

ORACLES["batch_outcome"] = f"""{ACCEPT}, c AS (SELECT owner_id,
    count(*) FILTER (outcome <> 'SKIP') AS created,
    count(*) FILTER (outcome = 'SKIP') AS duplicates_skipped,
    count(*) FILTER (outcome = 'DUPIMP') AS duplicates_imported FROM walk GROUP BY owner_id)
  SELECT owner_id, concat('batch-', owner_id) AS batch_id, created, duplicates_skipped,
    duplicates_imported, CASE WHEN created > 0 THEN 'IMPORTED'
      ELSE 'BATCH_IMPORT_NO_TRANSACTIONS_CREATED' END AS status FROM c"""

# Import: owners before usr_15 are moved ten years on; the others hold rows before 2000.
ORACLES["batch_import"] = f"""{ACCEPT}, bad AS (
    SELECT owner_id FROM inc WHERE owner_id >= 'usr_15' AND year(date) < 2000 GROUP BY owner_id),
  sums AS (SELECT w.owner_id, count(*) FILTER (outcome <> 'SKIP') AS created,
    count(*) FILTER (outcome = 'SKIP') AS duplicates_skipped,
    count(*) FILTER (outcome = 'DUPIMP') AS duplicates_imported,
    coalesce(cast(sum(amount) FILTER (outcome <> 'SKIP') AS double), 0) AS total
    FROM walk w JOIN inc ON w.row_pos = inc.row_pos GROUP BY w.owner_id)
  SELECT owner_id,
    CASE WHEN owner_id IN (FROM bad) THEN 0 ELSE created END AS created,
    CASE WHEN owner_id IN (FROM bad) THEN 0 ELSE duplicates_skipped END AS duplicates_skipped,
    CASE WHEN owner_id IN (FROM bad) THEN 0 ELSE duplicates_imported END AS duplicates_imported,
    CASE WHEN owner_id IN (FROM bad) THEN 'BATCH_VALIDATION_FAILED'
      WHEN created > 0 THEN 'IMPORTED' ELSE 'BATCH_IMPORT_NO_TRANSACTIONS_CREATED' END AS status,
    CASE WHEN owner_id IN (FROM bad) THEN 0 ELSE created END AS rows,
    CASE WHEN owner_id IN (FROM bad) THEN 0 ELSE created END AS ids,
    CASE WHEN owner_id IN (FROM bad) THEN 0 ELSE total END AS total,
    CASE WHEN owner_id IN (FROM bad) OR created = 0 THEN 0 ELSE 1 END AS files
  FROM sums"""

ORACLES["assigned_ids"] = """SELECT count(*) * 2 AS n, count(*) * 2 AS ids, 1001 AS low,
    1000 + count(*) * 2 AS high
  FROM orders JOIN customer ON o_custkey = c_custkey"""

LEDGER = """
  SELECT c_custkey + 1 AS id, c_custkey AS f, concat(c_name, '.csv') AS original_filename,
    CASE WHEN c_custkey % 5 <> 0 THEN concat('acct-', cast(c_custkey AS varchar)) END AS account_id,
    c_custkey % 50 AS transaction_count,
    concat('usr_', cast(c_custkey % 20 AS varchar)) AS imported_by FROM customer"""
UPLOADS = """
  SELECT o_orderkey AS upload_id, o_custkey + (o_orderkey % 4) * 1000 AS f,
    concat('usr_', cast((o_custkey + o_orderkey % 2) % 20 AS varchar)) AS imported_by,
    concat('upload-', cast(o_orderkey AS varchar), '.csv') AS original_filename,
    o_orderkey % 6 AS created FROM orders"""

ORACLES["import_ledger"] = f"""WITH led AS ({LEDGER}), up AS ({UPLOADS}),
  made AS (SELECT * FROM up WHERE created > 0),
  fresh AS (SELECT f, imported_by, arg_min(original_filename, upload_id) AS original_filename,
      arg_min(created, upload_id) AS transaction_count
    FROM made WHERE NOT EXISTS (SELECT 1 FROM led
      WHERE led.f = made.f AND led.imported_by = made.imported_by) GROUP BY f, imported_by),
  every AS (SELECT f, imported_by, original_filename, transaction_count FROM led
    UNION ALL SELECT f, imported_by, original_filename, transaction_count FROM fresh)
  SELECT made.upload_id AS batch_seq, every.original_filename, every.imported_by,
    every.transaction_count
  FROM made JOIN every ON made.f = every.f AND made.imported_by = every.imported_by"""

ORACLES["prior_imports"] = f"""WITH led AS ({LEDGER}), up AS ({UPLOADS})
  SELECT upload_id, led.id IS NOT NULL AS already_imported,
    CASE WHEN led.id IS NOT NULL THEN 'FILE_ALREADY_IMPORTED' END AS warning_code,
    led.original_filename AS previous_filename, led.account_id AS previous_account_id,
    CASE WHEN led.id IS NOT NULL THEN '2001-01-01 00:00:00' END AS previous_imported_at
  FROM up LEFT JOIN led ON up.f = led.f AND up.imported_by = led.imported_by"""

ORACLES["content_fingerprints"] = "SELECT doc_id, sha256(text) AS content_hash FROM documents"

ORACLES["file_checks"] = """SELECT page_id,
    CASE WHEN page_id % 9 = 0 THEN '' ELSE url END AS filename,
    CASE WHEN page_id % 10 = 0 THEN 0 ELSE strlen(html) END AS length,
    CASE WHEN page_id % 9 = 0 THEN 'MISSING_ORIGINAL_FILENAME'
      WHEN page_id % 10 = 0 OR strlen(html) = 0 THEN 'CSV_PARSING_ERROR' END AS error
  FROM pages"""

VIEWS = f"""{BASE}, v AS (SELECT s_suppkey AS s, concat('view-', cast(s_suppkey AS varchar)) AS view_id,
    concat('usr_', cast(s_suppkey % 20 AS varchar)) AS owner FROM supplier),
  m AS (SELECT view_id, id FROM v JOIN act ON owner = owner_id
    WHERE (s % 2 <> 0 OR s % 6 = 2 OR date <= DATE '2000-06-30')
      AND CASE s % 6 WHEN 1 THEN currency_iso_code = 'USD' AND type = 'DEBIT'
        WHEN 2 THEN date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'
        WHEN 3 THEN contains(lower(description), 'building')
          OR contains(lower(description), 'urgent')
        WHEN 4 THEN amount BETWEEN 1000 AND 250000 AND (contains(lower(bank_name), 'nation_1')
          OR contains(lower(bank_name), 'xyz'))
        WHEN 5 THEN contains(account_id, 'acct-1') ELSE true END),
  p AS (SELECT view_id, id FROM v JOIN act ON owner = owner_id AND id BETWEEN s * 10 AND s * 10 + 9),
  x AS (SELECT view_id, id FROM v
    JOIN act ON owner = owner_id AND id BETWEEN s * 10 + 5 AND s * 10 + 30)"""

ORACLES["view_membership"] = f"""{VIEWS}
  SELECT view_id, id AS transaction_id, 'MATCHED' AS membership FROM (FROM m EXCEPT FROM x)
  UNION ALL SELECT view_id, id, 'PINNED' FROM (FROM p EXCEPT FROM m)
  UNION ALL SELECT view_id, id, 'EXCLUDED' FROM x"""

ORACLES["view_counts"] = f"""{VIEWS}, e AS ((FROM m EXCEPT FROM x) UNION FROM p)
  SELECT v.view_id, count(e.id) AS n FROM v LEFT JOIN e ON v.view_id = e.view_id GROUP BY v.view_id"""

# Each event's effect on the two sets, the last effect on a set wins; stored sets come first.
EVENTS = f"""{BASE}, v AS (SELECT s_suppkey AS s, concat('view-', cast(s_suppkey AS varchar)) AS view_id,
    concat('usr_', cast(s_suppkey % 20 AS varchar)) AS owner FROM supplier),
  ev AS (SELECT concat('view-', cast(event_id // 60 AS varchar)) AS view_id,
      event_id // 60 * 90 + event_id % 15 AS transaction_id, CASE event_type WHEN 'view' THEN 'exclude'
        WHEN 'purchase' THEN 'unpin' WHEN 'signup' THEN 'unexclude' ELSE 'pin' END AS action,
      event_id AS seq FROM events),
  judged AS (SELECT ev.*, CASE WHEN action IN ('unpin', 'unexclude') OR act.id IS NOT NULL
      THEN 'APPLIED' ELSE 'NOT_FOUND' END AS outcome
    FROM ev JOIN v ON ev.view_id = v.view_id
    LEFT JOIN act ON act.id = transaction_id AND owner_id = owner)"""

ORACLES["pin_fold"] = f"""{EVENTS}, effect AS (
    SELECT view_id, transaction_id, seq, action = 'pin' AS is_p, action = 'exclude' AS is_x,
      action IN ('pin', 'unpin', 'exclude') AS sets_p,
      action IN ('pin', 'exclude', 'unexclude') AS sets_x FROM judged WHERE outcome = 'APPLIED'
    UNION ALL SELECT view_id, unnest(range(s * 10, s * 10 + 10)), -2, true, false, true, false FROM v
    UNION ALL SELECT view_id, unnest(range(s * 10 + 5, s * 10 + 31)), -1, false, true, false, true
      FROM v),
  f AS (SELECT view_id, transaction_id,
      coalesce(arg_max(is_p, seq) FILTER (sets_p), false) AS pinned,
      coalesce(arg_max(is_x, seq) FILTER (sets_x), false) AS excluded
    FROM effect GROUP BY view_id, transaction_id)
  SELECT * FROM f WHERE pinned OR excluded"""

ORACLES["view_bulk_update"] = f"""{EVENTS} SELECT view_id, action,
    count(DISTINCT transaction_id) FILTER (outcome = 'APPLIED') AS updated_count,
    count(*) FILTER (outcome = 'NOT_FOUND') AS not_found_count FROM judged GROUP BY view_id, action"""

ORACLES["stored_id_sets"] = """SELECT concat('view-', cast(s_suppkey AS varchar)) AS id,
    concat('[', array_to_string(range(s_suppkey * 10, s_suppkey * 10 + 5), ','), ']') AS only_pinned,
    31 AS either FROM supplier"""

ORACLES["view_list"] = """SELECT concat('view-', cast(s_suppkey AS varchar)) AS id, s_name AS name
  FROM supplier WHERE s_suppkey % 20 = 3"""

ORACLES["id_resolution"] = f"""{BASE}, q AS (SELECT event_id, event_id * 3 // 2 AS transaction_id,
    concat('usr_', cast(user_id % 20 AS varchar)) AS owner FROM events)
  SELECT transaction_id, owner AS owner_id, event_id, id IS NOT NULL AS found
  FROM q LEFT JOIN act ON id = transaction_id AND owner_id = owner"""

DELETES = f"""{BASE}, q AS (SELECT user_id AS request_id, event_id AS pos,
    event_id // 2 * 3 AS transaction_id,
    concat('usr_', cast(user_id % 20 AS varchar)) AS actor, event_type = 'error' AS a FROM events),
  ok AS (SELECT q.*, row_number() OVER (PARTITION BY transaction_id ORDER BY request_id, pos) AS rn
    FROM q JOIN act ON id = transaction_id AND (a OR owner_id = actor))"""

ORACLES["bulk_delete"] = f"""{DELETES} SELECT tx.id, tx.deleted OR ok.pos IS NOT NULL AS deleted,
    ok.actor AS deleted_by FROM tx LEFT JOIN ok ON tx.id = ok.transaction_id AND rn = 1"""

ORACLES["bulk_delete_outcome"] = f"""{DELETES} SELECT q.request_id, count(ok.pos) AS deleted_count,
    count(*) - count(ok.pos) AS not_found_count
  FROM q LEFT JOIN ok ON q.request_id = ok.request_id AND q.pos = ok.pos AND rn = 1
  GROUP BY q.request_id"""

PATCHES = f"""{BASE}, q AS (SELECT event_id AS seq, event_id // 3 * 4 AS transaction_id,
    concat('usr_', cast(user_id % 20 AS varchar)) AS actor,
    event_type IN ('error', 'signup') AS a,
    CASE WHEN event_type <> 'purchase' THEN concat('patched ', cast(event_id AS varchar)) END AS d,
    CASE WHEN event_id % 3 = 0 THEN concat('acct-new-', cast(user_id AS varchar)) END AS acc
    FROM events),
  ok AS (SELECT q.* FROM q JOIN act ON id = transaction_id AND (a OR owner_id = actor))"""

ORACLES["patch_apply"] = f"""{PATCHES}, f AS (SELECT transaction_id,
    arg_max(d, seq) FILTER (d IS NOT NULL) AS d, arg_max(acc, seq) FILTER (acc IS NOT NULL) AS acc
    FROM ok GROUP BY transaction_id)
  SELECT id, coalesce(d, description) AS description, coalesce(acc, account_id) AS account_id
  FROM tx LEFT JOIN f ON id = transaction_id"""

ORACLES["patch_outcome"] = f"""{PATCHES} SELECT q.seq, q.transaction_id,
    CASE WHEN ok.seq IS NULL THEN 'NOT_FOUND' ELSE 'UPDATED' END AS outcome
  FROM q LEFT JOIN ok ON q.seq = ok.seq"""

ORACLES["backfill_owner"] = """SELECT o_orderkey AS id, coalesce(
    CASE WHEN o_orderkey % 3 = 0 THEN concat('usr_', cast(o_custkey AS varchar)) END,
    CASE WHEN o_orderkey % 2 = 0 THEN concat('made_', cast(o_custkey AS varchar)) END,
    'migration') AS owner_id FROM orders"""

ORACLES["update_from"] = """SELECT o_orderkey AS id, f.format,
    coalesce(s_suppkey, -1) AS statement_format_id
  FROM (SELECT o_orderkey, concat('Supplier#', lpad(cast(o_custkey % 200 AS varchar), 9, '0')) AS format
    FROM orders) f LEFT JOIN supplier ON s_name = f.format"""

ORACLES["config_json"] = """SELECT s_suppkey + 1 AS statement_format_id, 1 AS revision_number,
    CASE WHEN csv THEN 'CSV_COLUMN_CONFIG' ELSE 'STATIC_HANDLER' END AS parser_type,
    CASE WHEN NOT csv THEN concat('key-', cast(s_suppkey % 8 AS varchar)) END AS handler_key,
    1 AS config_schema_version,
    CASE WHEN csv THEN concat('{"dateHeader":"Date","dateFormat":"MM/dd/uu","descriptionHeader":"Text \\"',
      cast(s_suppkey AS varchar), '\\"","creditHeader":"Credit","debitHeader":',
      CASE WHEN s_suppkey % 6 = 1 THEN '"Debit"' ELSE 'null' END,
      ',"typeHeader":null,"categoryHeader":null}') END AS parser_config,
    0 AS priority, s_suppkey % 7 <> 0 AS enabled
  FROM (SELECT *, s_suppkey % 3 <> 0 AS csv FROM supplier)"""

ORACLES["format_key_cleanup"] = """SELECT s_suppkey + 1 AS id, CASE s_suppkey % 8 WHEN 2 THEN 'key-two'
    WHEN 3 THEN 'key-three' ELSE concat('key-', cast(s_suppkey % 8 AS varchar)) END AS format_key
  FROM supplier WHERE s_suppkey % 8 NOT IN (1, 5)"""

FORMATS = """SELECT s_suppkey + 1 AS id,
    CASE WHEN s_suppkey % 10 = 0 THEN 'SYSTEM' ELSE 'USER' END AS scope,
    CASE WHEN s_suppkey % 10 <> 0 THEN concat('usr_', cast(s_suppkey % 20 AS varchar)) END AS owner_id,
    s_name AS display_name, concat('Bank ', cast(s_nationkey AS varchar)) AS bank_name,
    CASE s_suppkey % 4 WHEN 0 THEN 'THB' ELSE 'USD' END AS cur, s_suppkey % 7 <> 0 AS enabled
  FROM supplier"""

ORACLES["format_visibility"] = f"""WITH f AS ({FORMATS}), u AS (
    SELECT DISTINCT concat('usr_', cast(c_custkey % 20 AS varchar)) AS user_id FROM customer)
  SELECT user_id, id, scope FROM u JOIN f ON scope = 'SYSTEM' OR owner_id = user_id"""

ORACLES["format_list"] = f"""WITH f AS ({FORMATS})
  SELECT id, display_name FROM f WHERE scope = 'SYSTEM' OR owner_id = 'usr_3'"""

ORACLES["format_selection"] = f"""WITH f AS ({FORMATS}), q AS (SELECT event_id,
    concat('usr_', cast(user_id % 20 AS varchar)) AS user_id, event_id // 90 AS statement_format_id
    FROM events)
  SELECT statement_format_id, event_id, user_id,
    coalesce(enabled AND (scope = 'SYSTEM' OR owner_id = user_id), false) AS usable
  FROM q LEFT JOIN f ON id = statement_format_id"""

ORACLES["format_patch"] = f"""WITH f AS ({FORMATS}), q AS (SELECT event_id AS seq,
    event_id // 90 AS fid, concat('usr_', cast(user_id % 20 AS varchar)) AS u,
    event_type = 'error' AS a,
    CASE WHEN event_id % 4 = 0 THEN concat('Name ', cast(event_id AS varchar))
      WHEN event_id % 31 = 0 THEN ' ' END AS dn,
    CASE event_id % 5 WHEN 0 THEN 'eur' WHEN 1 THEN 'xxy' END AS c,
    CASE WHEN event_id % 7 = 0 THEN false END AS en FROM events),
  ok AS (SELECT q.* FROM q JOIN f ON id = fid AND (a OR (scope = 'USER' AND owner_id = u))
    WHERE coalesce(dn <> ' ', true) AND coalesce(c <> 'xxy', true)),
  g AS (SELECT fid, arg_max(dn, seq) FILTER (dn IS NOT NULL) AS dn,
    arg_max(c, seq) FILTER (c IS NOT NULL) AS c, arg_max(en, seq) FILTER (en IS NOT NULL) AS en
    FROM ok GROUP BY fid)
  SELECT id, scope, owner_id, coalesce(dn, display_name) AS display_name, bank_name,
    coalesce(upper(c), cur) AS default_currency_iso_code, coalesce(en, enabled) AS enabled
  FROM f LEFT JOIN g ON id = fid"""

ORACLES["format_create"] = """WITH old AS (SELECT
      CASE WHEN s_suppkey % 10 = 0 THEN 'SYSTEM' ELSE 'USER' END AS scope,
      CASE s_suppkey % 3 WHEN 0 THEN 'PDF' ELSE 'CSV' END AS format_type,
      CASE s_suppkey % 4 WHEN 0 THEN 'THB' ELSE 'USD' END AS default_currency_iso_code FROM supplier),
  new AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN 'SYSTEM' ELSE 'USER' END AS scope,
      'CSV' AS format_type, 'THB' AS default_currency_iso_code FROM customer
    WHERE c_custkey % 13 <> 0 AND c_custkey % 17 <> 0 AND c_custkey % 19 <> 0
      AND (c_custkey % 3 <> 0 OR c_custkey % 2 = 0))
  SELECT *, CASE format_type WHEN 'CSV' THEN 'CSV_COLUMN_CONFIG' ELSE 'STATIC_HANDLER' END
      AS parser_type, count(*) AS n, count(*) AS ids
  FROM (FROM old UNION ALL FROM new) GROUP BY ALL"""

ORACLES["format_create_errors"] = """WITH c AS (SELECT c_custkey AS seq, c_custkey % 5 AS f FROM customer),
  e AS (
    SELECT seq, 'displayName' AS field, 'This field needs a value.' AS message FROM c WHERE seq % 17 = 0
    UNION ALL SELECT seq, 'formatType', 'No format type given.' FROM c WHERE f = 0
    UNION ALL SELECT seq, 'formatType',
      'A user may add CSV formats only.' FROM c WHERE f = 1
    UNION ALL SELECT seq, 'defaultCurrencyIsoCode',
      'The default currency is no ISO 4217 code.' FROM c WHERE seq % 19 = 0
    UNION ALL SELECT seq, 'dateHeader', 'This field needs a value.' FROM c WHERE seq % 7 = 0 AND f > 1
    UNION ALL SELECT seq, 'debitHeader', 'This field needs a value.' FROM c WHERE f > 1
    UNION ALL SELECT seq, 'scope',
      'Formats for all need the permission statementformats:write:any.' FROM c
      WHERE seq % 3 = 0 AND seq % 2 = 1)
  SELECT * FROM e"""

ORACLES["validation_errors"] = f"""{BASE}, inc AS ({INCOMING})
  SELECT owner_id, row_pos, 'date' AS field, concat('Transaction date ', cast(date AS varchar),
    CASE WHEN year(date) < 2000
      THEN ' is too early: the first accepted day is 2000-01-01.'
      ELSE ' is too late: it lies more than a day in the future.' END)
    AS message, cast(date AS varchar) AS value
  FROM inc WHERE year(date) < 2000 OR date > DATE '2001-01-02'"""

ORACLES["batch_validation"] = f"""{BASE}, inc AS ({INCOMING}), b AS (
    SELECT owner_id, batch_id, count(*) AS rows,
      count(*) FILTER (owner_id >= 'usr_15' AND year(date) < 2000) AS errors
    FROM inc GROUP BY owner_id, batch_id)
  SELECT *, CASE WHEN errors > 0 THEN 'BATCH_VALIDATION_FAILED' ELSE 'VALID' END AS status FROM b"""

ORACLES["required_fields"] = f"""{BASE}, inc AS ({INCOMING}),
  f(k, field) AS (VALUES (7, 'date'), (5, 'description'), (11, 'amount'), (13, 'type'),
    (3, 'bankName'))
  SELECT owner_id, row_pos, field, concat(field, ' is required') AS message
  FROM inc JOIN f ON row_pos % k = 0"""

ORACLES["config_audit"] = """WITH c AS (SELECT c_custkey AS id, c_custkey % 2 = 0 AS signed,
    c_custkey % 7 = 0 AS deb, c_custkey % 8 < 3 AS cred FROM customer), r AS (
  SELECT id, 'fileType' AS field, 'A table configuration reads text of PDF files only.' AS message
    FROM c WHERE id % 23 = 0
  UNION ALL SELECT id, 'headerMustContain', 'Name one header word or more.'
    FROM c WHERE id % 4 = 0
  UNION ALL SELECT id, 'headerMustContain', 'A header word is blank.'
    FROM c WHERE id % 4 = 1
  UNION ALL SELECT id, 'minimumRows', 'The least number of rows is one.' FROM c WHERE id % 3 = 0
  UNION ALL SELECT id, 'dateHeader', 'This field needs a value.' FROM c WHERE id % 5 = 0
  UNION ALL SELECT id, 'dateFormat', 'Text tables do not read this date pattern.'
    FROM c WHERE id % 6 = 0
  UNION ALL SELECT id, 'dateFormat', 'This field needs a value.' FROM c WHERE id % 6 = 1
  UNION ALL SELECT id, 'amountHeader',
    'A signed amount and debit or credit columns exclude each other.'
    FROM c WHERE signed AND (deb OR cred)
  UNION ALL SELECT id, 'negativeMeans',
    'A signed amount needs a type column, or what a minus sign means.'
    FROM c WHERE signed AND NOT (deb OR cred) AND id % 10 <> 0 AND id % 9 <> 0
  UNION ALL SELECT id, 'debitHeader', 'This field needs a value.' FROM c WHERE NOT signed AND NOT deb
  UNION ALL SELECT id, 'creditHeader', 'This field needs a value.' FROM c WHERE NOT signed AND NOT cred
  UNION ALL SELECT id, 'yearSource', 'No year source given.' FROM c WHERE id % 11 = 0)
  SELECT * FROM r"""

# The codes stand in one place only, as three lists of fixed values.
# Fixed values, written out a second time for comparison: ISO 4217 codes in use, of units, and withdrawn.
IN_USE = """
AED AFN ALL AMD ANG AOA ARS AUD AWG AZN BAM BBD BDT BGN BHD BIF BMD BND BOB BRL BSD BTN BWP BYN
BZD CAD CDF CHF CLP CNY COP CRC CUP CVE CZK DJF DKK DOP DZD EGP ERN ETB EUR FJD FKP GBP GEL GHS
GIP GMD GNF GTQ GYD HKD HNL HTG HUF IDR ILS INR IQD IRR ISK JMD JOD JPY KES KGS KHR KMF KPW KRW
KWD KYD KZT LAK LBP LKR LRD LSL LYD MAD MDL MGA MKD MMK MNT MOP MRU MUR MVR MWK MXN MYR MZN NAD
NGN NIO NOK NPR NZD OMR PAB PEN PGK PHP PKR PLN PYG QAR RON RSD RUB RWF SAR SBD SCR SDG SEK SGD
SHP SLE SOS SRD SSP STN SVC SYP SZL THB TJS TMT TND TOP TRY TTD TWD TZS UAH UGX USD UYU UZS VES
VND VUV WST XAF XCD XOF XPF YER ZAR ZMW ZWL
""".split()
UNITS = """
BOV CHE CHW CLF COU MXV USN USS UYI XAD XAG XAU XBA XBB XBC XBD XCG XDR XFO XFU XPD XPT XSU XTS
XUA XXX
""".split()
WITHDRAWN = """
ADP AFA ATS AYM AZM BEF BGL BYB BYR CSD CUC CYP DEM EEK ESP FIM FRF GHC GRD GWP HRK IEP ITL LTL
LUF LVL MGF MRO MTL MZM NLG PTE ROL RUR SDD SIT SKK SLL SRG STD TMM TPE TRL VEB VED VEF YUM ZMK
ZWD ZWG ZWN ZWR
""".split()

ORACLES["currency_codes"] = f"""WITH c AS (SELECT concat(chr(cast(97 + o_orderkey // 26 % 26 AS int)),
    chr(cast(97 + o_orderkey % 26 AS int)), chr(cast(97 + n AS int))) AS code FROM orders, unnest(range(26)) AS r(n))
  SELECT code, count(*) AS orders, upper(code) IN ({", ".join(f"'{c}'" for c in [*IN_USE, *UNITS, *WITHDRAWN])}) AS known
  FROM c GROUP BY code"""

ORACLES["revision_selection"] = """WITH l AS (SELECT l_orderkey AS o, l_linenumber AS n,
    min(l_suppkey) AS s FROM lineitem GROUP BY 1, 2),
  a AS (SELECT *, (o + n + s) % 5 AS h, row_number() OVER (PARTITION BY o
      ORDER BY CASE WHEN (o + n + s) % 5 = 0 THEN 0 ELSE 1 END, n % 2 DESC, n DESC) AS rn FROM l),
  g AS (SELECT o, count(*) AS attempts, count(*) FILTER (h = 0) AS hits,
      count(*) FILTER (h IN (1, 2)) AS fails FROM a GROUP BY o)
  SELECT cast(a.o AS varchar) AS file_id,
    CASE WHEN hits > 0 THEN a.o * 10 + n ELSE -1 END AS parser_revision_id,
    CASE WHEN hits > 0 THEN 'MATCHED' WHEN attempts = 1 AND fails = 1 THEN 'FAILED'
      ELSE 'FORMAT_NOT_SUPPORTED' END AS status,
    CASE WHEN hits = 0 AND attempts = 1 AND fails = 1 THEN concat('failure ', cast(n AS varchar)) END
      AS diagnostic,
    CASE WHEN hits > 0 THEN s ELSE 0 END AS row_count, hits AS matched_count, attempts AS attempt_count
  FROM a JOIN g ON a.o = g.o WHERE rn = 1"""


def csv_rows(shift: int) -> str:
    """Source rows of the rendered CSV files, with the date that the layout's pattern tells."""
    return f"""SELECT o_orderkey // 50 AS n, o_orderkey AS k, o_orderpriority AS p,
      o_orderstatus = 'F' AS debit, round(o_totalprice, 2) AS amount,
      row_number() OVER (PARTITION BY o_orderkey // 50 ORDER BY o_orderkey) + 1 AS row_pos,
      cast(o_orderdate AS date) + {shift} AS d FROM orders"""


def csv_row_columns(prefix: str) -> str:
    return f"""SELECT concat('{prefix}-', cast(n AS varchar)) AS file_id, row_pos, cast(d AS varchar) AS date,
    CASE n % 3 WHEN 0 THEN concat('Order ', cast(k AS varchar), ' ', p)
      WHEN 1 THEN concat('Order, "', cast(k AS varchar), '" ',
        CASE WHEN k % 9 = 0 THEN concat(chr(10), 'line two') ELSE 'one line' END)
      ELSE concat('Order ', cast(k AS varchar)) END AS description, amount,
    CASE WHEN debit THEN 'DEBIT' ELSE 'CREDIT' END AS type,
    CASE WHEN n % 3 = 1 THEN p END AS category,
    CASE n % 3 WHEN 0 THEN 'Siam Bank' WHEN 1 THEN 'First Bank' ELSE 'Third Bank' END AS bank_name,
    CASE n % 3 WHEN 0 THEN 'THB' WHEN 1 THEN 'USD' ELSE 'EUR' END AS currency_iso_code,
    concat('acct-', cast(n AS varchar)) AS account_id
  FROM r"""


ORACLES["csv_statement_roundtrip"] = f"WITH r AS ({csv_rows(3653)}) {csv_row_columns('csv')}"

ORACLES["csv_large_files"] = f"""WITH o AS ({csv_rows(3653)}),
  r AS (SELECT * EXCLUDE (n, row_pos), n % 3 AS n,
    row_number() OVER (PARTITION BY n % 3 ORDER BY k) + 1 AS row_pos FROM o)
  {csv_row_columns('big')}"""

ORACLES["csv_file_status"] = f"""WITH r0 AS ({csv_rows(0)}),
  r AS (SELECT *, CASE WHEN n % 3 = 0 THEN make_date(2000 + year(d) % 100, month(d), day(d)) ELSE d END
    AS told FROM r0),
  e AS (SELECT *, CASE WHEN year(told) < 2000 THEN concat('Date ''', cast(told AS varchar),
      ''' at line ', cast(row_pos AS varchar), ' is prior to year 2000, the first that is accepted.')
    WHEN told > DATE '2001-01-02' THEN concat('Date ''', cast(told AS varchar),
      ''' at line ', cast(row_pos AS varchar), ' lies more than a day ahead.') END AS err FROM r),
  g AS (SELECT n, count(*) AS rows, arg_min(err, row_pos) FILTER (err IS NOT NULL) AS err
    FROM e GROUP BY n)
  SELECT concat('csv-', cast(n AS varchar)) AS file_id, n % 3 * 10 + 11 AS parser_revision_id,
    1 AS revision_number, CASE WHEN err IS NULL THEN 'MATCHED' ELSE 'FAILED' END AS status,
    err AS diagnostic, CASE WHEN err IS NULL THEN rows ELSE 0 END AS row_count FROM g
  UNION ALL SELECT concat('csv-', cast(n AS varchar)), 12, 2, 'NOT_APPLICABLE',
    'Extractor cannot handle the uploaded file.', 0 FROM g WHERE n % 3 = 0"""

ORACLES["csv_header_match"] = """SELECT DISTINCT
    concat('csv-', cast(o_orderkey // 50 AS varchar)) AS file_id,
    o_orderkey // 50 % 3 = 0 AS columns, o_orderkey // 50 % 3 = 1 AS typed, false AS absent
  FROM orders"""


def statement_rows(per_file: int) -> str:
    return f"""SELECT *, start + cast(k % 30 AS int) AS d FROM (
      SELECT o_orderkey // {per_file} AS n, o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS p,
        round(o_totalprice, 2) AS amount, make_date(cast(2005 + (o_orderkey // {per_file}) % 15 AS int),
          cast(1 + (o_orderkey // {per_file}) % 12 AS int), 10) AS start FROM orders)"""


def statement(kind: str, per_file: int, *columns: str, where: str = "true") -> str:
    return (
        f"WITH r AS ({statement_rows(per_file)}) SELECT concat('{kind}-', cast(n AS varchar)) AS file_id, "
        + ", ".join(columns)
        + f" FROM r WHERE {where}"
    )


DAY = "cast(d AS varchar) AS date"
LONG = "concat('Order ', cast(k AS varchar), ' ', p) AS description"
SHORT = "concat('Order ', cast(k AS varchar)) AS description"
CARD = ("amount", "'Capital One' AS bank_name", "'USD' AS currency_iso_code")
CARD_TYPE = "CASE WHEN s = 'F' OR k % 7 = 0 THEN 'CREDIT' ELSE 'DEBIT' END AS type"

ORACLES["card_monthly_roundtrip"] = statement("card", 30, DAY, LONG, CARD_TYPE, *CARD)
ORACLES["card_split_roundtrip"] = statement("split", 30, DAY, LONG, CARD_TYPE, *CARD)

ACCOUNT = (
    "CASE WHEN s = 'F' THEN concat('360 Checking ...', cast(5000 + n % 1000 AS varchar)) "
    "ELSE 'Savings Now ...987' END"
)
ORACLES["bank_monthly_roundtrip"] = statement(
    "bank", 30,
    "cast(CASE WHEN month(d) > month(start + 30) + 1 THEN make_date(year(start + 30) - 1, month(d), day(d))"
    " ELSE make_date(year(start + 30), month(d), day(d)) END AS varchar) AS date",
    LONG, "CASE WHEN s = 'O' THEN 'CREDIT' ELSE 'DEBIT' END AS type",
    f"{ACCOUNT} AS category", f"{ACCOUNT} AS account_id", *CARD,
)
ORACLES["card_yearly_roundtrip"] = statement(
    "year", 30, "cast(make_date(year(start), month(d), day(d)) AS varchar) AS date", SHORT,
    "CASE WHEN k % 7 = 0 THEN 'CREDIT' ELSE 'DEBIT' END AS type",
    "CASE WHEN s = 'F' THEN 'Dining' ELSE 'travel/airfare' END AS category", *CARD,
)

ORACLES["layout_attempts"] = """WITH f AS (SELECT o_orderkey // 30 AS n, count(*) AS c FROM orders GROUP BY 1),
  k(kind, own) AS (VALUES ('card', 'capital-one-credit-monthly-statement'),
    ('bank', 'capital-one-bank-monthly-statement'), ('year', 'capital-one-credit-yearly-statement'))
  SELECT concat(k.kind, '-', cast(n AS varchar)) AS file_id, h.own AS handler_key,
    CASE WHEN k.own = h.own THEN 'MATCHED' ELSE 'NOT_APPLICABLE' END AS status,
    CASE WHEN k.own <> h.own THEN 'Extractor cannot handle the uploaded file.' END AS diagnostic,
    CASE WHEN k.own = h.own THEN c ELSE 0 END AS row_count
  FROM f CROSS JOIN k CROSS JOIN k h"""

TWO = (
    DAY, SHORT, "amount", "CASE WHEN s = 'O' THEN 'CREDIT' ELSE 'DEBIT' END AS type",
    "'Bangkok Bank' AS bank_name", "'THB' AS currency_iso_code",
    "concat('acct-', cast(n AS varchar)) AS account_id",
)
ORACLES["two_column_roundtrip"] = statement("two", 20, *TWO)
ORACLES["two_column_text_roundtrip"] = statement("txt", 20, *TWO)

ORACLES["text_table_roundtrip"] = statement(
    "tab", 20, "CASE WHEN n % 2 = 0 THEN 51 ELSE 61 END AS parser_revision_id",
    "cast(CASE WHEN n % 2 = 0 THEN make_date(year(start), month(d), day(d)) ELSE d END AS varchar) AS date",
    SHORT, "amount",
    "CASE WHEN n % 2 = 0 THEN CASE WHEN k % 7 = 0 THEN 'CREDIT' ELSE 'DEBIT' END"
    " WHEN s = 'O' THEN 'CREDIT' ELSE 'DEBIT' END AS type",
    "CASE WHEN n % 2 = 0 THEN 'Table Bank' ELSE 'Column Bank' END AS bank_name",
    "CASE WHEN n % 2 = 0 THEN 'USD' ELSE 'EUR' END AS currency_iso_code",
    "concat('acct-', cast(n AS varchar)) AS account_id",
)

ORACLES["line_grouping"] = """WITH r AS (SELECT o_orderkey // 20 AS n,
    CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END AS page FROM orders),
  g AS (SELECT n, page, count(*) AS lines, count(*) * 4 AS cells FROM r GROUP BY 1, 2
    UNION ALL SELECT DISTINCT n, 1, 3, 2 + 7 + 3 FROM r)
  SELECT concat('two-', cast(n AS varchar)) AS file_id, page, sum(lines)::bigint AS lines,
    sum(cells)::bigint AS cells FROM g GROUP BY n, page"""

ORACLES["table_detection"] = """WITH f AS (SELECT o_orderkey // 20 AS n, count(*) AS c FROM orders GROUP BY 1)
  SELECT concat('tab-', cast(n AS varchar)) AS file_id, 1 AS page,
    CASE WHEN n % 2 = 0 THEN 2 ELSE 1 END AS start_line,
    CASE WHEN n % 2 = 0 THEN 3 + c ELSE 2 + c END AS end_line,
    CASE WHEN n % 2 = 0 THEN 'Transaction Date|Description|Amount' ELSE 'Date|Memo|Debit|Credit' END
      AS header,
    c AS row_count, CASE WHEN n % 2 = 0 THEN 0 ELSE 1 END AS repeated_headers FROM f"""

ORACLES["text_sufficiency"] = """SELECT cast(conv_id AS varchar) AS file_id,
    sum(length(regexp_replace(text, '^[ \\t\\n]+|[ \\t\\n]+$', '', 'g')))::bigint AS characters,
    sum(length(regexp_replace(text, '^[ \\t\\n]+|[ \\t\\n]+$', '', 'g'))) >= 20 AS sufficient
  FROM conversations GROUP BY conv_id"""

ORACLES["header_scores"] = """WITH h AS (SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'Posting Date'
      WHEN 1 THEN 'Memo/Details' WHEN 2 THEN 'AMOUNT ($)' WHEN 3 THEN 'Withdrawal'
      WHEN 4 THEN 'Credit/Debit' WHEN 5 THEN 'Category' WHEN 6 THEN 'Value' ELSE p_name END AS header
    FROM part),
  t AS (SELECT *, regexp_replace(lower(header), '[^a-z0-9]', '', 'g') AS x FROM h)
  SELECT p_partkey, header,
    CASE WHEN x IN ('date','transactiondate','postingdate','posted') THEN 0.95::double
      WHEN regexp_matches(x, 'date|posted') THEN 0.75 ELSE 0 END AS date,
    CASE WHEN x IN ('description','memo','particulars','narrative','payee','merchant','details')
        THEN 0.95::double
      WHEN regexp_matches(x, 'description|memo|particulars|narrative|payee|merchant|details')
        THEN 0.75 ELSE 0 END AS description,
    CASE WHEN x IN ('amount','transactionamount','value') THEN 0.95::double
      WHEN regexp_matches(x, 'amount|value') THEN 0.75 ELSE 0 END AS amount,
    CASE WHEN x IN ('debit','withdrawal','withdraw','outflow') THEN 0.95::double
      WHEN regexp_matches(x, 'debit|withdraw|outflow') THEN 0.75 ELSE 0 END AS debit,
    CASE WHEN x IN ('credit','deposit','payment','inflow') THEN 0.95::double
      WHEN regexp_matches(x, 'credit|deposit|payment|inflow') THEN 0.75 ELSE 0 END AS credit,
    CASE WHEN x IN ('type','transactiontype','creditdebit','drcr') THEN 0.95::double
      WHEN regexp_matches(x, 'type|creditdebit|drcr') THEN 0.75 ELSE 0 END AS type,
    CASE WHEN x IN ('category','classification') THEN 0.95::double
      WHEN regexp_matches(x, 'category|classification') THEN 0.75 ELSE 0 END AS category
  FROM t"""

ORACLES["date_format_inference"] = """WITH g AS (SELECT o_orderkey // 10 AS n,
    bool_and(day(o_orderdate) <= 12) AS month_first,
    bool_and(day(o_orderdate) >= 10 AND month(o_orderdate) >= 10) AS wide FROM orders GROUP BY 1)
  SELECT n, CASE n % 5 WHEN 0 THEN 'MM/dd/uu'
      WHEN 1 THEN CASE WHEN month_first THEN CASE WHEN wide THEN 'MM/dd/uuuu' ELSE 'M/d/uuuu' END
        ELSE CASE WHEN wide THEN 'dd/MM/uuuu' ELSE 'd/M/uuuu' END END
      WHEN 2 THEN 'uuuu-MM-dd' WHEN 3 THEN 'd MMM uuuu HH:mm' ELSE 'none' END AS date_format FROM g"""

ORACLES["table_date_format"] = """WITH o AS (SELECT o_orderkey AS id, o_orderkey % 8 AS v,
    day(o_orderdate) AS d, month(o_orderdate) AS m, monthname(o_orderdate) AS mn FROM orders)
  SELECT id, CASE v
    WHEN 0 THEN concat(CASE WHEN m < 10 THEN 'M' ELSE 'MM' END, '/', CASE WHEN d < 10 THEN 'd' ELSE 'dd' END,
      '/uu')
    WHEN 1 THEN CASE WHEN d > 12 THEN 'dd/MM/uuuu' ELSE 'MM/dd/uuuu' END
    WHEN 2 THEN 'MM/dd' WHEN 3 THEN CASE WHEN m = 5 THEN 'MMM d, uuuu' ELSE 'MMMM d, uuuu' END
    WHEN 4 THEN 'MMM d' WHEN 5 THEN 'uuuu-MM-dd' WHEN 6 THEN 'MMM d uuuu' ELSE 'none' END AS date_format
  FROM o"""

ORACLES["csv_mapping"] = f"""WITH r AS ({csv_rows(3653)}),
  f AS (SELECT n, bool_and(day(d) <= 12) AS month_first FROM r GROUP BY n)
  SELECT concat('csv-', cast(n AS varchar)) AS file_id, CASE n % 3
      WHEN 0 THEN 'Date|Particulars|Withdrawal|Deposit'
      WHEN 1 THEN 'Transaction Date|Transaction Description|Transaction Amount|Transaction Type|Category'
      ELSE 'Posted|Memo|Credit|Debit' END AS headers,
    CASE n % 3 WHEN 0 THEN 'Date' WHEN 1 THEN 'Transaction Date' ELSE 'Posted' END AS date_column,
    CASE n % 3 WHEN 0 THEN CASE WHEN month_first THEN 'MM/dd/uu' ELSE 'dd/MM/uu' END
      WHEN 1 THEN 'MM/dd/uuuu' ELSE 'd MMM uuuu HH:mm' END AS date_format,
    CASE n % 3 WHEN 0 THEN 'Particulars' WHEN 1 THEN 'Transaction Description' ELSE 'Memo' END
      AS description_column,
    CASE WHEN n % 3 = 1 THEN 'Transaction Amount' END AS amount_column,
    CASE n % 3 WHEN 0 THEN 'Withdrawal' WHEN 2 THEN 'Debit' END AS debit_column,
    CASE n % 3 WHEN 0 THEN 'Deposit' WHEN 2 THEN 'Credit' END AS credit_column,
    CASE WHEN n % 3 = 1 THEN 'Transaction Type' END AS type_column,
    CASE WHEN n % 3 = 1 THEN 'Category' END AS category_column,
    CASE WHEN n % 3 = 1 THEN 'SINGLE_AMOUNT_WITH_TYPE' ELSE 'DEBIT_CREDIT_COLUMNS' END AS amount_mode,
    CASE WHEN n % 3 = 1 THEN 0.9::double ELSE 0.95::double END AS confidence, '' AS warnings FROM f"""

ORACLES["mapping_preview"] = f"""WITH r AS ({csv_rows(3653)})
  SELECT concat('csv-', cast(n AS varchar)) AS file_id, 'MATCHED' AS status, NULL::varchar AS field,
    count(*) AS rows, cast(sum(cast(amount AS decimal(38,2))) AS double) AS total
  FROM r GROUP BY n"""

ORACLES["mapping_audit"] = """WITH f AS (SELECT DISTINCT o_orderkey // 50 AS n FROM orders),
  r(k, field, message) AS (VALUES (4, 'bankName', 'No bank name given.'),
    (5, 'defaultCurrencyIsoCode', 'The default currency is no ISO 4217 code.'),
    (6, 'mapping.dateColumn', 'The file has no such column.'),
    (7, 'mapping.dateFormat', 'CSV files are not read by this date pattern.'))
  SELECT concat('csv-', cast(n AS varchar)) AS file_id, field, message FROM f JOIN r ON n % k = 0"""

ORACLES["table_ranking"] = """WITH f0 AS (SELECT o_orderkey // 20 AS n, count(*) AS c
    FROM orders GROUP BY 1),
  x AS (SELECT o_orderkey // 20 AS n, bool_or(o_orderkey % 7 = 0) AS neg,
    bool_or(day(make_date(cast(2005 + o_orderkey // 20 % 15 AS int), cast(1 + o_orderkey // 20 % 12 AS int), 10)
      + cast(o_orderkey % 30 AS int)) > 12) AS day_first FROM orders GROUP BY 1),
  f AS (SELECT f0.*, neg, day_first FROM f0 JOIN x ON f0.n = x.n)
  SELECT concat('tab-', cast(n AS varchar)) AS file_id,
    concat('p1-l', CASE WHEN n % 2 = 0 THEN '2' ELSE '1' END, '-',
      cast(CASE WHEN n % 2 = 0 THEN 3 + c ELSE 2 + c END AS varchar)) AS candidate_id, 1 AS rank,
    CASE WHEN n % 2 = 0 THEN 0.99::double ELSE 0.97::double END AS confidence,
    CASE WHEN n % 2 = 0 THEN 'Transaction Date' ELSE 'Date' END AS date_header,
    CASE WHEN n % 2 = 0 THEN 'MMM d' WHEN day_first THEN 'dd/MM/uuuu' ELSE 'MM/dd/uuuu' END
      AS date_format,
    CASE WHEN n % 2 = 0 THEN 'Description' ELSE 'Memo' END AS description_header,
    CASE WHEN n % 2 = 0 THEN 'SIGNED_AMOUNT' ELSE 'DEBIT_CREDIT_COLUMNS' END AS amount_mode,
    CASE WHEN n % 2 = 0 THEN 'Amount' END AS amount_header,
    CASE WHEN n % 2 = 1 THEN 'Debit' END AS debit_header,
    CASE WHEN n % 2 = 1 THEN 'Credit' END AS credit_header,
    CASE WHEN n % 2 = 0 AND neg THEN 'CREDIT' END AS negative_means,
    CASE WHEN n % 2 = 0 AND NOT neg THEN 'It is open what a minus sign of the signed amount means, a credit or a debit.'
      ELSE '' END AS rejection_reasons
  FROM f"""

ORACLES["table_mapping_preview"] = """SELECT concat('tab-', cast(o_orderkey // 20 AS varchar)) AS file_id,
    'MATCHED' AS status, count(*) AS row_count, NULL::varchar AS field, NULL::varchar AS message
  FROM orders GROUP BY o_orderkey // 20"""

ORACLES["id_equals"] = f"{BASE} SELECT {PUBLIC} FROM act WHERE id = 700"

ORACLES["not_found_ids"] = f"""{DELETES} SELECT q.request_id,
    row_number() OVER (PARTITION BY q.request_id ORDER BY q.pos) AS place, q.transaction_id
  FROM q LEFT JOIN ok ON q.request_id = ok.request_id AND q.pos = ok.pos AND rn = 1
  WHERE ok.pos IS NULL"""

ORACLES["patch_errors"] = """SELECT doc_id AS seq,
    CASE WHEN length(text) > 500 THEN 'description' ELSE 'account_id' END AS field
  FROM documents WHERE length(text) > 500 OR length(source) * (1 + doc_id % 40) > 100"""

ORACLES["transaction_sink"] = f"""{BASE} SELECT id, year(date) AS year, owner_id,
    cast(amount AS double) AS amount, description FROM tx"""

ORACLES["stored_bulk_delete"] = f"""{DELETES} SELECT tx.id, tx.deleted OR ok.pos IS NOT NULL AS deleted,
    ok.actor AS deleted_by, CASE WHEN year(date) <> 1997 THEN true END AS file_kept
  FROM tx LEFT JOIN ok ON tx.id = ok.transaction_id AND rn = 1 AND year(date) = 1997"""

ORACLES["stored_patch_apply"] = f"""{PATCHES}, f AS (SELECT transaction_id,
    arg_max(d, seq) FILTER (d IS NOT NULL) AS d, arg_max(acc, seq) FILTER (acc IS NOT NULL) AS acc
    FROM ok GROUP BY transaction_id)
  SELECT id, coalesce(d, description) AS description, coalesce(acc, account_id) AS account_id,
    CASE WHEN year(date) <> 1997 THEN true END AS file_kept
  FROM tx LEFT JOIN f ON id = transaction_id AND year(date) = 1997"""

ORACLES["imported_files"] = """SELECT s_suppkey AS supplier, strlen(s_name) + 1 AS length,
    NULL::varchar AS error, s_suppkey % 6 = 0 AS already_imported,
    CASE WHEN s_suppkey % 6 = 0 THEN s_suppkey + 500 END AS previous_import_id,
    CASE WHEN s_suppkey % 6 = 0 THEN concat(s_name, '.csv') END AS previous_filename,
    CASE WHEN s_suppkey % 6 = 0 THEN 'FILE_ALREADY_IMPORTED' END AS warning_code
  FROM supplier"""

ORACLES["stored_view_edits"] = f"""WITH e AS ({ORACLES["pin_fold"]}),
  g AS (SELECT view_id, string_agg(cast(transaction_id AS varchar), ',' ORDER BY transaction_id)
      FILTER (pinned) AS p, string_agg(cast(transaction_id AS varchar), ',' ORDER BY transaction_id)
      FILTER (excluded) AS x FROM e GROUP BY view_id)
  SELECT concat('view-', cast(s_suppkey AS varchar)) AS id, concat('[', coalesce(p, ''), ']') AS pinned_ids,
    concat('[', coalesce(x, ''), ']') AS excluded_ids
  FROM supplier LEFT JOIN g ON view_id = concat('view-', cast(s_suppkey AS varchar))"""

ORACLES["table_analysis"] = """SELECT concat('tab-', cast(o_orderkey // 20 AS varchar)) AS file_id,
    CASE WHEN o_orderkey // 20 % 2 = 0 THEN 0.99::double ELSE 0.97::double END AS confidence,
    NULL::varchar AS rejection_reason FROM orders GROUP BY o_orderkey // 20
  UNION ALL SELECT concat('none-', cast(c_custkey AS varchar)), 0::double,
    'There is too little text in the file; scans are not read.'
  FROM customer"""

ORACLES["file_preview"] = """WITH o AS (SELECT o_orderkey AS k,
    cast(round(o_totalprice, 2) AS decimal(38,2)) AS amount FROM orders),
  sheets AS (SELECT k // 50 AS n, count(*) AS c, count(*) FILTER (k % 5 = 0) AS twice, sum(amount) AS total
    FROM o GROUP BY 1),
  cards AS (SELECT k // 30 AS n, count(*) AS c, sum(amount) AS total FROM o GROUP BY 1),
  sheets20 AS (SELECT k // 20 AS n, count(*) AS c, sum(amount) AS total FROM o GROUP BY 1),
  s AS (SELECT *, n % 3 = 0 OR (n % 3 = 1 AND n % 2 = 0) AS usable FROM sheets)
  SELECT concat('csv-', cast(n AS varchar)) AS file_id,
    CASE WHEN usable THEN 'MATCHED' ELSE 'STATEMENT_FORMAT_NOT_FOUND' END AS status,
    CASE WHEN NOT usable THEN -1 WHEN n % 3 = 0 THEN 11 ELSE 21 END AS parser_revision_id,
    CASE WHEN NOT usable THEN 0 WHEN n % 3 = 0 THEN 2 ELSE 1 END AS attempts,
    CASE WHEN usable THEN c ELSE 0 END AS rows,
    CASE WHEN n % 3 = 0 THEN twice ELSE 0 END AS duplicates,
    CASE WHEN usable THEN cast(total AS double) END AS total, n % 3 = 0 AS already_imported FROM s
  UNION ALL SELECT concat(kind, '-', cast(n AS varchar)), 'MATCHED', revision, attempts, c, 0,
    cast(total AS double), false FROM cards,
    (VALUES ('card', 41, 3), ('bank', 43, 3), ('year', 71, 1)) AS v(kind, revision, attempts)
  UNION ALL SELECT concat('two-', cast(n AS varchar)), 'MATCHED', 72, 1, c, 0, cast(total AS double), false FROM sheets20
  UNION ALL SELECT concat('tab-', cast(n AS varchar)), 'MATCHED', 81 + n % 2, 2, c, 0, cast(total AS double), false
  FROM sheets20"""


def hot_text(step: int) -> str:
    return f"""upper(regexp_replace(concat('CARDPAYMENTSIAMMALL', p_name,
      translate(lpad(cast(p_partkey % {step} AS varchar), 3, '0'), '0123456789', 'ABCDEFGHIJ'), p_type),
      '[^A-Za-z]', '', 'g'))"""


ORACLES["hot_key_marking"] = f"""WITH i AS (SELECT p_partkey AS row_pos, {hot_text(997)} AS t FROM part),
  s AS (SELECT DISTINCT {hot_text(89)} AS t FROM part WHERE p_size = 7),
  u AS (SELECT t, min(row_pos) AS first FROM i GROUP BY t),
  near(a, b) AS (SELECT u.t, v.t FROM u JOIN (SELECT t FROM u UNION SELECT t FROM s) v
    ON u.t = v.t OR (abs(length(u.t) - length(v.t)) * 10 <= greatest(length(u.t), length(v.t))
      AND levenshtein(u.t, v.t) * 10 <= greatest(length(u.t), length(v.t)))),
  e AS (SELECT DISTINCT a AS t FROM near JOIN s ON s.t = near.b),
  f AS (SELECT a AS t, min(first) AS earliest FROM near JOIN u ON u.t = near.b GROUP BY a)
  SELECT row_pos, CASE WHEN e.t IS NOT NULL THEN 'EXISTING_TRANSACTION'
    WHEN f.earliest < row_pos THEN 'IN_BATCH' END AS duplicate_reason
  FROM i JOIN f USING (t) LEFT JOIN e USING (t)"""
