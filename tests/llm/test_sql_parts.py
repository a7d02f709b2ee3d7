"""What SQL can say of operators whose whole result it can't: counts of base spans, and payloads."""

import duckdb
import pytest

from netloom.llm import queries

SF = "/root/testdata/sf0.01"

SECRETS = r"""select doc_id,
  len(list_filter(regexp_extract_all(t, '(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 'i'), lambda x: len(x) >= 8)) as n_assign,
  len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: len(x) >= 16)) as n_access,
  len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: len(x) >= 32)) as n_hex
from (select doc_id, coalesce(text, '') as t from documents)"""

PERSONAL = r"""with m as (select doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') as email,
    regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') as ip,
    list_transform(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) as card,
    list_transform(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) as phone
  from (select doc_id, coalesce(text, '') as t from documents))
select doc_id, len(email) as n_email,
  len(list_filter(ip, lambda x: list_max(list_transform(string_split(x, '.'), lambda p: p::double)) <= 255)) as n_ip,
  len(list_filter(card, lambda x: len(x) between 12 and 19 and list_sum(list_transform(range(len(x)), lambda i:
    case when i % 2 = 0 then substr(x, len(x) - i, 1)::int else (2 * substr(x, len(x) - i, 1)::int) // 10 + (2 * substr(x, len(x) - i, 1)::int) % 10 end)) % 10 = 0)) as n_card,
  len(list_filter(phone, lambda x: len(x) between 9 and 15)) as n_phone
from m"""

MEDIA = """with b as (select doc_id, encode(coalesce(text, '')) as raw from documents),
z as (select doc_id, raw, octet_length(raw) as n, case when octet_length(raw) = 0 then 64 else (64 - octet_length(raw) % 64) % 64 end as pad from b)
select doc_id, n as n_bytes, n + pad as payload_bytes, sha256(raw || unhex(repeat('00', pad::int))) as payload_sha256 from z"""


@pytest.mark.parametrize("query, sql", [("op3_secrets", SECRETS), ("op6_personal_data", PERSONAL), ("op8_ogg_media", MEDIA)])
def test_against_sql(spark, query, sql):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.sql(sql)
    got = getattr(queries, query)(spark, SF).select(want.columns).collect()
    rows = sorted(want.fetchall())
    assert sorted(map(tuple, got)) == rows and len(rows) >= 1000
