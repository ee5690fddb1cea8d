"""Columns that SQL can express of queries that it can't express as a whole, over whole tables; a transport stream written by hand."""

import duckdb
import pytest

from gaugeworks.llm import queries, transport_stream

SF, WITH_SECRETS = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def in_sql(text, sf=SF):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM read_parquet('{sf}/documents.parquet')")
    return con.execute(text).fetchall()


def found(spark, query, *columns, sf=SF):
    return sorted(tuple(r) for r in query(spark, sf).select(*columns).collect())


def test_mixing_sizes_and_targets(spark):
    want = in_sql(r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 3.0::DOUBLE * sum(size) AS cap, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2 ELSE 1 END AS weight FROM d GROUP BY source),
level(round, level) AS (
  SELECT 0, sum(source_size)::DOUBLE / sum(weight) FROM s
  UNION ALL
  SELECT round + 1, (sum(source_size) - sum(CASE WHEN weight * level > cap THEN cap ELSE 0 END)) / sum(CASE WHEN weight * level > cap THEN 0 ELSE weight END) FROM level, s WHERE round < 50 GROUP BY round, level)
SELECT doc_id, size, source_size, least(cap, weight * (SELECT max(level) FROM level)) FROM d JOIN s ON s.source IS NOT DISTINCT FROM d.source ORDER BY doc_id""")
    got = found(spark, queries.op4_mixing, "doc_id", "size", "source_size", "target")
    assert [r[:3] for r in got] == [r[:3] for r in want] and all(a[3] == pytest.approx(b[3], rel=1e-9) for a, b in zip(got, want, strict=True))
    assert sum({r[2]: r[3] for r in got}.values()) > 0 and max(r[3] / r[2] for r in got if r[2]) <= 3 + 1e-9


def test_secret_counts_and_digests(spark):
    kinds = (
        (0, "assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", r"""len(regexp_extract(m, '["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 8"""),
        (1, "access", "AKIA[A-Z0-9]+", "len(m) >= 16"),
        (2, "hex", "[0-9a-f]+", "len(m) >= 32"),
    )
    quoted = [(k, name, p.replace("'", "''"), ok) for k, name, p, ok in kinds]
    # What lies between matches tells where they stand.
    parts = " UNION ALL ".join(f"SELECT doc_id, {k} AS k, '{name}' AS kind, unnest(regexp_extract_all(t, '{p}')) AS m, unnest(string_split_regex(t, '{p}')[:-2]) AS before, generate_subscripts(regexp_extract_all(t, '{p}'), 1) AS i FROM d" for k, name, p, _ in quoted)
    keeps = " OR ".join(f"k = {k} AND {ok}" for k, _, _, ok in quoted)
    want = in_sql(f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), p AS ({parts}),
q AS (SELECT *, sum(len(before) + len(m)) OVER (PARTITION BY doc_id, k ORDER BY i) AS stop FROM p),
b AS (SELECT doc_id, k, kind, stop - len(m) AS start, stop FROM q WHERE {keeps}),
g AS (SELECT doc_id, count_if(k = 0) AS a, count_if(k = 1) AS c, count_if(k = 2) AS h, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) AS spans FROM b GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0), coalesce(c, 0), coalesce(h, 0), sha256(coalesce(spans, '')) FROM d LEFT JOIN g USING (doc_id) ORDER BY doc_id""", WITH_SECRETS)
    assert sum(r[1] + r[3] for r in want) > 0
    assert found(spark, queries.op9_secret_scan, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", sf=WITH_SECRETS) == want


def test_media_sizes_and_digests(spark):
    want = in_sql("""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
e AS (SELECT *, greatest(64, (n + 63) // 64 * 64) AS size FROM d)
SELECT doc_id, n, size, sha256(t || repeat(chr(0), size - n)) FROM e ORDER BY doc_id""")
    assert found(spark, queries.op10_transport_stream, "doc_id", "n_bytes", "payload_bytes", "payload_sha256") == want


def hand_made():
    """Tables, clock and times in the layout of a usual multiplexer: program 1, its map on 0x1000, its stream on 0x100. The first
    unit begins with a clock reference and ends behind stuffing; the second has a decoding time too and fits in one packet."""
    a, b = bytes(range(200, 256)) * 8, b"0123456789"
    a = a[:446]
    packets = [
        bytes.fromhex("474000100000b00d0001c100000001f0002ab104b2").ljust(188, b"\xff"),
        bytes.fromhex("475000100002b0120001c10000e100f0001be100f00015bd4d56").ljust(188, b"\xff"),
        bytes.fromhex("471fff10").ljust(188, b"\xff"),
        bytes.fromhex("47410030" "07500000" "7b0c7e00" "000001bd01c6808005" "210007d861") + a[:162],
        bytes.fromhex("47010011") + a[162:346],
        bytes.fromhex("47010032" "5300") + b"\xff" * 82 + a[346:],
        bytes.fromhex("47410033" "9a00") + b"\xff" * 153 + bytes.fromhex("000001bd001780c00a" "310007f481" "110007d861") + b,
    ]
    return packets, a, b


def test_a_stream_written_by_hand():
    packets, a, b = hand_made()
    assert {len(p) for p in packets} == {188}
    read = transport_stream.read_stream(b"".join(packets))
    assert read["payload"] == a + b and read["times"] == [126_000, 129_600] and read["points"] == [3]
    assert (read["program"], read["stream_type"], read["packets"], read["gaps"], read["damaged"]) == (1, 0x1B, 7, 0, 0)
    for lost in (4, 5):
        media = b"".join(packets[:lost] + packets[lost + 1 :])
        told = transport_stream.read_stream(media, strict=False)
        assert (told["payload"], told["times"], told["gaps"], told["damaged"]) == (b, [129_600], 1, 1)
        with pytest.raises(ValueError):
            transport_stream.read_stream(media)
    damaged = bytearray(b"".join(packets))
    damaged[20] ^= 1  # the association's checksum
    with pytest.raises(ValueError):
        transport_stream.read_stream(bytes(damaged), strict=False)
