"""DuckDB equivalents of the queries, with the same parameters and column names."""

from __future__ import annotations

KV = "kv AS (SELECT user_id AS key, event_id + 1 AS seq, CASE WHEN event_type = 'error' THEN 'DELETE' ELSE 'PUT' END AS op, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value FROM events)"
TOP = "SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM"
RUNS = f"{KV}, runs AS (SELECT *, (seq - 1) // 1000 AS run_id, 0 AS level, 'L0-' || ((seq - 1) // 1000)::VARCHAR AS file_id, 25 + CASE WHEN value IS NULL THEN 0 ELSE 8 END AS est FROM kv)"
FILES = f"{RUNS}, files AS (SELECT run_id, file_id, min(key) AS min_key, max(key) AS max_key, sum(est)::BIGINT AS file_size, (run_id % 3)::INT AS level FROM runs GROUP BY ALL)"
SCORES = f"{FILES}, scores AS (SELECT level, CASE WHEN level = 0 THEN count(*) / 4.0 ELSE sum(file_size) / (32768.0 * power(10.0, greatest(level, 1) - 1)) END::DOUBLE AS score FROM files GROUP BY level)"
PICK = f"{SCORES}, job AS (SELECT level, level + 1 AS target_level, score FROM scores WHERE score >= 1 AND level < 3 ORDER BY score DESC, level DESC LIMIT 1)"
BLOCKS = f"{RUNS}, blocks AS (SELECT *, (dense_rank() OVER (PARTITION BY file_id ORDER BY key) - 1) // 16 AS block FROM runs)"
SPOT = "((('0x' || substr(md5(key::VARCHAR), 1, 8))::UBIGINT::BIGINT + i * ('0x' || substr(md5(key::VARCHAR), 9, 8))::UBIGINT::BIGINT) % 1024)"
PROBES = f"{RUNS}, own AS (SELECT DISTINCT run_id, key FROM runs), probes AS (SELECT 'L0-' || run_id::VARCHAR AS file_id, run_id, key FROM (SELECT * FROM own UNION SELECT run_id + 1, key FROM own WHERE run_id + 1 IN (SELECT run_id FROM own) UNION SELECT run_id, -key - 1 FROM own))"
BIT = "CASE WHEN spot % 64 = 63 THEN (-9223372036854775808)::BIGINT ELSE 1::BIGINT << (spot % 64)::INT END"
BLOOM = f"{RUNS}, spots AS (SELECT DISTINCT file_id, {SPOT} AS spot FROM (SELECT DISTINCT file_id, key FROM runs), range(7) t(i)), bloom AS (SELECT file_id, spot // 64 AS word, bit_or({BIT}) AS bits FROM spots GROUP BY ALL)"
WAL = f"""{KV}, wal AS (
  SELECT (seq - 1) // 2000 AS segment, 3 * seq + 1 AS pos, op AS rtype, key, value, seq FROM kv
  UNION ALL SELECT (seq - 1) // 2000, 3 * seq, 'BATCH_START', NULL, NULL, seq FROM kv WHERE seq % 200 = 1
  UNION ALL SELECT (seq - 1) // 2000, 3 * seq + 2, 'BATCH_END', NULL, NULL, seq FROM kv WHERE seq % 200 = 100 AND seq % 700 <> 0)"""
MANIFEST = f"""{RUNS}, acts AS (
  SELECT DISTINCT 2 * run_id AS pos, 'ADD' AS act, 0 AS level, file_id FROM runs
  UNION ALL SELECT 1000000001 + i, 'REMOVE', 0, 'L0-' || i::VARCHAR FROM range(4) t(i)
  UNION ALL SELECT 1000000100, 'ADD', 1, 'L1-1'
  UNION ALL SELECT 2000000001 + i, 'REMOVE', 0, 'L0-' || (4 + i)::VARCHAR FROM range(2) t(i)
  UNION ALL SELECT 2000000100, 'ADD', 1, 'L1-2')"""


def _applied(where: str) -> str:
    """The batch rule: lost are records whose last marker is a start that no end follows next."""
    return f"""{WAL}, seen AS (SELECT * FROM wal WHERE {where}),
      marked AS (SELECT *,
        last_value(CASE WHEN rtype LIKE 'BATCH%' THEN rtype END IGNORE NULLS) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
        first_value(CASE WHEN rtype LIKE 'BATCH%' THEN rtype END IGNORE NULLS) OVER (ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM seen),
      applied AS (SELECT key, seq, rtype AS op, value FROM marked WHERE rtype IN ('PUT', 'DELETE') AND (before IS NULL OR before = 'BATCH_END' OR after = 'BATCH_END'))"""


def _visible(where: str = "true", columns: str = "key, value, seq", source: str = "kv") -> str:
    return f"SELECT {columns} FROM ({TOP} (SELECT * FROM {source} WHERE {where})) WHERE rn = 1 AND op = 'PUT'"


def _garbage(floor: str, drop: bool) -> str:
    rank = f"row_number() OVER (PARTITION BY key, seq <= {floor} ORDER BY seq DESC)"
    puts = " AND op = 'PUT'" if drop else ""
    return f"WITH {KV} SELECT key, seq, op, value FROM (SELECT *, {rank} AS rn FROM kv) WHERE seq > {floor} OR (rn = 1{puts})"


def _log(table: str) -> str:
    return {
        "orders": "lg AS (SELECT o_custkey AS key, o_orderkey + 1 AS seq, CASE WHEN o_orderstatus = 'F' THEN 'DELETE' ELSE 'PUT' END AS op, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice END AS value FROM orders)",
        "documents": "lg AS (SELECT source AS key, doc_id + 1 AS seq, 'PUT' AS op, text AS value FROM documents)",
        "conversations": "lg AS (SELECT conv_id AS key, turn AS seq, 'PUT' AS op, text AS value FROM conversations)",
    }[table]


MAX = "9223372036854775807"

ORACLE_SQL: dict[str, str] = {
    "kv_latest_state": f"WITH {KV} {_visible()}",
    "kv_get_latest": f"WITH {KV} {_visible('key = 8', 'key, value')}",
    "kv_get_live": f"WITH {KV} {_visible('key = 9', 'key, value')}",
    "kv_get_snapshot": f"WITH {KV} {_visible('key = 8 AND seq <= 5000', 'key, value')}",
    "kv_multi_get": f"WITH {KV} {_visible("key IN (SELECT key FROM kv WHERE op = 'DELETE')", 'key, value')}",
    "kv_scan_range": f"WITH {KV} {_visible('key >= 20 AND key < 60', 'row_number() OVER (ORDER BY key) AS pos, key, value, seq')}",
    "kv_scan_snapshot": f"WITH {KV} {_visible('key >= 20 AND key < 60 AND seq <= 5000')}",
    "kv_scan_from": f"WITH {KV} {_visible('key >= 100')}",
    "kv_scan_until": f"WITH {KV} {_visible('key < 30')}",
    "kv_scan_inverted": f"WITH {KV} {_visible('key >= 60 AND key < 20')}",
    "kv_scan_prefix": f"WITH {KV}, named AS (SELECT 'user:' || lpad(key::VARCHAR, 8, '0') AS key, seq, op, value FROM kv) " + _visible("key >= 'user:0000001' AND key < 'user:0000002'", source="named"),
    "kv_versions_range": f"WITH {KV} SELECT key, seq, op, value FROM kv WHERE key >= 20 AND key < 60 AND seq <= 5000",
    "kv_snapshot_bounded": f"WITH {KV} SELECT key, seq, op FROM kv WHERE seq <= 5000",
    "kv_skip_tombstones": f"WITH {KV} {_visible(columns='key, seq, value')}",
    "kv_binary_order": "SELECT row_number() OVER (ORDER BY unhex(h)) AS pos, h AS key_hex FROM (VALUES (''), ('61'), ('6162'), ('7F'), ('80'), ('FF'), ('00'), ('6100'), ('FFFF')) t(h)",
    "kv_dedup_newest": f"WITH {KV} SELECT key, seq, op FROM ({TOP} kv) WHERE rn = 1",
    "kv_idempotent_replay": f"WITH {KV}, twice AS (SELECT * FROM kv UNION ALL SELECT * FROM kv) {_visible(source='twice')}",
    "kv_version_count": f"WITH {KV} SELECT key, count(*) AS n FROM kv GROUP BY key",
    "kv_tombstone_count": f"WITH {KV} SELECT key, count(*) FILTER (op = 'DELETE') AS n FROM kv GROUP BY key",
    "kv_orders_latest": f"WITH {_log('orders')} {_visible(source='lg')}",
    "kv_documents_latest": f"WITH {_log('documents')} {_visible(columns='key, length(value)::BIGINT AS chars, seq', source='lg')}",
    "kv_turns_latest": f"WITH {_log('conversations')} {_visible(source='lg')}",
    "kv_apply_puts": f"WITH {KV}, more AS (SELECT * FROM kv UNION ALL SELECT i * 4, (SELECT max(seq) FROM kv) + i + 1, 'PUT', i * 4 * 1.5 FROM range(100) t(i)) {_visible(source='more')}",
    "kv_apply_deletes": f"WITH {KV}, more AS (SELECT * FROM kv UNION ALL SELECT i * 2, (SELECT max(seq) FROM kv) + i + 1, 'DELETE', NULL FROM range(50) t(i)) {_visible(source='more')}",
    "kv_overwrites": f"WITH {KV}, c AS (SELECT key, count(*) FILTER (op = 'PUT') AS versions FROM kv GROUP BY key HAVING count(*) FILTER (op = 'PUT') >= 2) SELECT c.key, c.versions, t.value FROM c JOIN (SELECT * FROM ({TOP} kv) WHERE rn = 1) t USING (key)",
    "kv_entry_size": f"WITH {RUNS} SELECT key, seq, est::BIGINT AS est_bytes FROM runs",
    "kv_flush_runs": f"WITH {RUNS} SELECT run_id, count(*) AS entries, sum(est)::BIGINT AS bytes FROM runs GROUP BY run_id",
    "kv_flush_l0_metadata": f"WITH {RUNS} SELECT file_id, level, min(key) AS min_key, max(key) AS max_key, count(*) AS entry_count, min(seq) AS min_seq, max(seq) AS max_seq FROM runs GROUP BY file_id, level",
    "kv_flush_sorted_run": f"WITH {RUNS} SELECT file_id, row_number() OVER (PARTITION BY run_id ORDER BY key, seq DESC) AS pos, key, seq, op FROM runs",
    "kv_memtable_rotation": f"WITH {RUNS} SELECT run_id, count(*) AS entries, sum(est)::BIGINT AS bytes, max(seq) AS max_seq FROM (SELECT seq, est, (coalesce(sum(est) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 30000)::BIGINT AS run_id FROM runs) GROUP BY run_id",
    "kv_merge_runs": f"WITH {KV} SELECT row_number() OVER (ORDER BY key, seq DESC) AS pos, key, seq, op FROM kv",
    "kv_pruned_lookup": f"WITH {RUNS}, t AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS rn FROM runs WHERE key = 8) SELECT file_id, key, value, seq FROM t WHERE rn = 1",
    "kv_files_for_key": f"WITH {FILES} SELECT file_id FROM files WHERE min_key <= 8 AND max_key >= 8",
    "kv_overlapping_files": f"WITH {FILES} SELECT file_id, min_key, max_key FROM files WHERE max_key >= 20 AND min_key <= 60",
    "kv_bloom_build": f"WITH {BLOOM} SELECT file_id, word, bits FROM bloom",
    "kv_bloom_probe": f"WITH {PROBES}, held AS (SELECT DISTINCT file_id, {SPOT} AS spot FROM (SELECT DISTINCT file_id, key FROM runs), range(7) t(i)), asked AS (SELECT file_id, run_id, key, {SPOT} AS spot FROM probes, range(7) t(i)) SELECT a.file_id, a.key, bool_and(h.spot IS NOT NULL) AS maybe, bool_or(o.key IS NOT NULL) AS present FROM asked a LEFT JOIN held h ON a.file_id = h.file_id AND a.spot = h.spot LEFT JOIN own o ON a.run_id = o.run_id AND a.key = o.key GROUP BY a.file_id, a.key",
    "kv_bloom_fpr": f"WITH {RUNS} SELECT file_id, count(DISTINCT key) AS n, round(power(1 - exp(-7.0 * count(DISTINCT key) / 1024.0), 7), 9) AS fpr FROM runs GROUP BY file_id",
    "kv_sparse_index": f"WITH {BLOCKS} SELECT file_id, block, min(key) AS first_key, count(DISTINCT key) AS n FROM blocks GROUP BY file_id, block",
    "kv_sparse_index_lookup": f"WITH {BLOCKS}, {PROBES.removeprefix(RUNS + ', ')}, idx AS (SELECT file_id, block, min(key) AS first_key FROM blocks GROUP BY ALL) SELECT p.file_id, p.key, coalesce(max(i.block), 0) AS block FROM probes p LEFT JOIN idx i ON p.file_id = i.file_id AND i.first_key <= p.key GROUP BY ALL",
    "kv_block_layout": f"WITH {BLOCKS} SELECT file_id, block, count(DISTINCT key) AS keys, count(*) AS versions FROM blocks GROUP BY file_id, block",
    "kv_level_counts": f"WITH {FILES} SELECT level, count(*) AS files, sum(file_size)::BIGINT AS bytes FROM files GROUP BY level",
    "kv_compaction_scores": f"WITH {SCORES} SELECT level, score FROM scores",
    "kv_compaction_pick": f"WITH {PICK} SELECT level, target_level, score FROM job",
    "kv_compaction_inputs": f"""WITH {PICK}, src AS (SELECT * FROM (SELECT f.*, j.target_level, row_number() OVER (ORDER BY min_key, file_id) AS rn FROM files f JOIN job j USING (level)) WHERE level = 0 OR rn = 1)
      SELECT 'source' AS role, file_id FROM src
      UNION ALL SELECT 'target', f.file_id FROM files f, (SELECT min(min_key) AS lo, max(max_key) AS hi, min(target_level) AS t FROM src) h WHERE f.level = h.t AND f.max_key >= h.lo AND f.min_key <= h.hi""",
    "kv_compact_no_snapshot": _garbage(MAX, False),
    "kv_compact_with_snapshot": _garbage("5000", False),
    "kv_compact_drop_tombstones": _garbage("5000", True),
    "kv_compact_keep_tombstones": _garbage(MAX, False),
    "kv_compaction_stats": f"WITH {RUNS}, t AS ({TOP} runs) SELECT count(*) AS rows_in, count(*) FILTER (rn = 1) AS rows_out, sum(est)::BIGINT AS bytes_in, (sum(est) FILTER (rn = 1))::BIGINT AS bytes_out FROM t",
    "kv_wal_read": f"WITH {WAL} SELECT segment, row_number() OVER (PARTITION BY segment ORDER BY pos) - 1 AS frame, rtype, key, seq FROM wal",
    "kv_wal_segments": f"WITH {WAL} SELECT segment, min(seq) AS min_seq, max(seq) AS max_seq, count(*) AS records FROM wal GROUP BY segment",
    "kv_wal_unflushed_segments": f"WITH {WAL} SELECT segment FROM wal GROUP BY segment HAVING max(seq) > 4050",
    "kv_wal_trim": f"WITH {WAL} SELECT segment FROM wal GROUP BY segment HAVING max(seq) <= 4050 AND segment < (SELECT max(segment) FROM wal)",
    "kv_wal_replay": f"WITH {_applied('seq > 4050')} SELECT key, seq, op, value FROM applied",
    "kv_wal_batches": f"WITH {_applied('true')} SELECT key, seq FROM applied",
    "kv_wal_lenient": f"WITH {_applied('pos < 27001')} SELECT key, seq FROM applied",
    "kv_wal_strict": f"WITH {WAL} SELECT count(*) AS bad_frames FROM wal WHERE pos = 27001",
    "kv_recover_sequence": f"WITH {_applied('seq > 4050')} SELECT greatest(4050, coalesce(max(seq), 0))::BIGINT AS recovered_seq FROM applied",
    "kv_manifest_rebuild": f"WITH {MANIFEST} SELECT level, file_id FROM (SELECT *, row_number() OVER (PARTITION BY level, file_id ORDER BY pos DESC) AS rn FROM acts) WHERE rn = 1 AND act = 'ADD'",
    "kv_manifest_rollback": f"WITH {MANIFEST}, undone AS (SELECT * FROM acts UNION ALL SELECT {MAX}, 'REMOVE', 1, 'L1-2' UNION ALL SELECT {MAX}, 'ADD', 0, 'L0-4' UNION ALL SELECT {MAX}, 'ADD', 0, 'L0-5') SELECT level, file_id FROM (SELECT *, row_number() OVER (PARTITION BY level, file_id ORDER BY pos DESC) AS rn FROM undone) WHERE rn = 1 AND act = 'ADD'",
    "kv_flushed_sequence": f"WITH {KV} SELECT max(seq) AS flushed_seq FROM kv",
    "kv_missing_files": f"WITH {RUNS} SELECT DISTINCT file_id FROM runs WHERE run_id % 4 = 3",
    "kv_oldest_snapshot": f"SELECT coalesce(min(seq), {MAX}) AS oldest, sum(n)::BIGINT AS active FROM (SELECT seq, sum(n) AS n FROM (VALUES (3000, 1), (5000, 1), (5000, 1), (9000, 1), (3000, -1)) t(seq, n) GROUP BY seq) WHERE n > 0",
    "kv_checksum_validate": f"WITH {WAL} SELECT segment, CASE WHEN segment % 4 = 0 THEN 1 ELSE 0 END::BIGINT AS bad, count(*) - CASE WHEN segment % 4 = 0 THEN 1 ELSE 0 END AS good FROM wal GROUP BY segment",
    "kv_lru_sim": f"""WITH {KV}, acc AS (SELECT key, key % 16 AS shard, seq, lag(seq) OVER (PARTITION BY key ORDER BY seq) AS prev FROM kv),
      near AS (SELECT a.seq, count(DISTINCT b.key) AS others FROM acc a LEFT JOIN acc b ON a.shard = b.shard AND b.seq > a.prev AND b.seq < a.seq WHERE a.prev IS NOT NULL GROUP BY a.seq),
      n AS (SELECT (SELECT count(*) FROM near WHERE others < 4) AS hits, (SELECT count(*) FROM acc) AS asked, (SELECT sum(least(4, k)) FROM (SELECT count(DISTINCT key) AS k FROM acc GROUP BY shard)) AS held)
      SELECT hits, asked - hits AS misses, (asked - hits - held)::BIGINT AS evictions FROM n""",
    "kv_codec_roundtrip": """WITH t AS (SELECT conv_id::VARCHAR AS k, CASE WHEN turn % 5 = 0 THEN 'DELETE' ELSE 'PUT' END AS op, CASE WHEN turn % 5 <> 0 THEN text END AS v FROM conversations)
      SELECT printf('%08X', strlen(k)) || hex(k) AS key_hex, md5(unhex(CASE op WHEN 'PUT' THEN '01' ELSE '02' END || printf('%08X', strlen(coalesce(v, ''))) || hex(coalesce(v, '')))) AS value_md5,
        (5 + strlen(coalesce(v, '')))::INT AS value_bytes, k AS key_back, op AS op_back, v AS value_back FROM t""",
    "kv_hit_ratio": f"WITH {KV} SELECT coalesce(round(100.0 * count(*) FILTER (op = 'PUT') / nullif(count(*), 0)), 0)::BIGINT AS ratio FROM kv",
    "kv_op_counters": f"WITH {KV} SELECT 'writes.total' AS metric, count(*) AS n FROM kv UNION ALL SELECT 'deletes.total', count(*) FILTER (op = 'DELETE') FROM kv",
    "kv_value_percentiles": f"WITH {KV} SELECT count(value) AS n, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99, max(value) AS mx FROM kv",
}
