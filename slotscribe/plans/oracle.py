"""The same queries as plain SQL over the sample tables, for checking results."""

from __future__ import annotations

_CALLS = """(select event_id as tx_sig, event_id as slot, event_type as ix_name, user_id,
    cast(json_extract_string(props, '$.k') as integer) as k, value, ts as created_at from events)"""
_ACCOUNTS = """(select user_id as address, event_id as slot, cast(round(value * 100) as bigint) as lamports, event_type,
    cast(json_extract_string(props, '$.k') as integer) as k from events)"""
_TXS = """(select o_orderkey as signature, cast(date_diff('day', date '1970-01-01', cast(o_orderdate as date)) as bigint) as slot,
    o_orderkey as tx_index, case when o_orderstatus = 'F' then 'failed' end as err, o_custkey as payer from orders)"""
_TWO_ATTEMPTS = """(select o_orderkey, cast(date_diff('day', date '1970-01-01', cast(o_orderdate as date)) as bigint) as slot,
      cast(round(o_totalprice * 100) as bigint) as cents, cast(1 as bigint) as seq from orders
    union all
    select o_orderkey, cast(date_diff('day', date '1970-01-01', cast(o_orderdate as date)) as bigint),
      cast(round(o_totalprice * 100) as bigint) + 1, cast(2 as bigint) from orders)"""
_NAMES = """(select c_name as name from customer union select c_mktsegment from customer union select s_name from supplier
    union select p_name from part union select p_brand from part union select p_type from part
    union select o_orderpriority from orders union select n_name from nation union select event_type from events
    union select role from conversations union select lang from documents)"""
# Open lines as transactions of the sample program.
_LINES = """(select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity as integer)) as signature,
    cast(date_diff('day', date '1970-01-01', cast(l_shipdate as date)) as bigint) as slot,
    case l_returnflag when 'A' then 'acceptLine' when 'N' then 'newLine' else 'returnLine' end as ix_name,
    l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice from lineitem where l_linestatus = 'O')"""


def _snake(column: str) -> str:
    return f"lower(substr({column}, 1, 1) || regexp_replace(substr({column}, 2), '([A-Z])', '_\\1', 'g'))"


_RESERVED = """('authorization','between','case','cast','check','collate','column','constraint','create','cross',
    'current_date','current_role','current_time','current_timestamp','current_user','data','default','desc','distinct',
    'drop','else','end','fetch','for','foreign','from','grant','group','in','index','into','join','like','limit','not',
    'null','offset','on','only','open','or','order','primary','references','returning','row','select','session','some',
    'table','then','to','trigger','union','unique','user','using','value','values','where','with')"""


def _column(column: str) -> str:
    clean = f"regexp_replace({_snake(column)}, '[^\\p{{L}}\\p{{N}}_]', '_', 'g')"
    return f"case when {clean} in {_RESERVED} then 'f_' || left({clean}, 57) else left({clean}, 59) end"


def _series(bucket: str) -> str:
    return f"""select event_type as ix_name, cast(date_trunc('{bucket}', ts) as timestamp) as period, count(*) as calls
        from events where ts between timestamp '2000-01-01' and timestamp '2100-01-01' group by 1, 2"""


_ROUND_TRIP = "select event_id as tx_sig, event_id, user_id, event_type from events"
_P64 = "cast(18446744073709551616 as hugeint)"
_SCALARS = f"""select event_id, user_id % 2 = 1 as flag, cast(user_id % 256 as integer) as a8, cast(event_id % 65536 as integer) as a16,
    (event_id * 1000) % 4294967296 as a32,
    cast(((user_id - event_id + 128) % 256 + 256) % 256 - 128 as integer) as b8,
    cast(((user_id - event_id + 32768) % 65536 + 65536) % 65536 - 32768 as integer) as b16,
    cast(user_id - event_id as integer) as b32, user_id - event_id as b64,
    value as f8, cast({_P64} - 1 - event_id as varchar) as a64,
    cast(cast(user_id as hugeint) * {_P64} + event_id as varchar) as a128,
    cast(cast(-1 - user_id as hugeint) * {_P64} + event_id as varchar) as b128,
    cast(cast(value as float) as double) as f4, cast(0 as bigint) as issues from events"""
_NESTED = """select event_id, case when event_id % 2 = 0 then user_id end as opt,
    case event_id % 4 when 0 then '' else array_to_string(list_transform(range(1, event_id % 4 + 1), lambda i: cast((user_id + i) % 65536 as varchar)), ',') end as items,
    concat(event_id % 4, ',', user_id % 256) as pair, event_id as inner_id, event_type as inner_tag,
    lower(hex(encode(props))) as blob, lower(hex(encode(event_type))) as rest, true as late_missing, 'truncated' as issues from events"""

_EXPLICIT = "(c_acctbal > 5000)"
_REGISTRY = f"""
    select 'P' || c_custkey as program_id, c_name as program_name, 'instruction' as kind, cast(0 as bigint) as ordinal,
      'set' || upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) as name,
      'ix_set_' || lower(c_mktsegment) as table_name, true as has_table,
      substr(sha256('global:set' || upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2))), 1, 16) as disc,
      'amount_in,slot' as columns, 'u64,u32' as types from customer
    union all
    select 'P' || c_custkey, c_name, 'instruction', 1, 'nationNo' || c_nationkey, 'ix_nation_no' || c_nationkey, c_acctbal >= 0,
      case when {_EXPLICIT} then printf('%02x', c_nationkey) || '02030405060708' else substr(sha256('global:nationNo' || c_nationkey), 1, 16) end,
      case when c_acctbal >= 0 then 'amount_in' else '' end, case when c_acctbal >= 0 then 'u64' else '' end from customer
    union all
    select 'P' || c_custkey, c_name, 'account', 0, 'CustomerState', 'acc_customer_state', c_acctbal >= 0,
      substr(sha256('account:CustomerState'), 1, 16),
      case when c_acctbal >= 0 then 'owner_key,f_order,' || {_snake('c_mktsegment')} else '' end,
      case when c_acctbal >= 0 then 'publicKey,u64,bool' else '' end from customer"""

_STATS = f"""select count(*) as total_transactions, count(*) as total_ix_calls,
    '{{' || '"ix_accept_line":' || count(*) filter (ix_name = 'acceptLine') || ',"ix_new_line":' || count(*) filter (ix_name = 'newLine')
      || ',"ix_return_line":' || count(*) filter (ix_name = 'returnLine') || '}}' as ix_call_counts,
    min(slot) as first_indexed_slot, max(slot) as last_indexed_slot from {_LINES}"""

_WIDE = """select event_id, true as empty, 'int128_overflow,int128_overflow=' || (cast('340282366920938463463374607431768211455' as uhugeint) - cast(event_id as uhugeint))
      || ',int128_overflow=' || (cast('170141183460469231731687303715884105727' as hugeint) - event_id)
      || ',int128_overflow=' || (cast('-170141183460469231731687303715884105728' as hugeint) + event_id) as issues from events"""
_SHORT = """select event_id, array_to_string(list_transform(range(1, event_id % 3 + 1), lambda i: cast((user_id + i) % 65536 as varchar)), ',') as items,
      case when event_id % 5 > event_id % 3 then 'vec_len_capped,vec_len_capped=' || event_id % 5 else '' end as issues from events where event_id % 3 <= event_id % 5"""

ORACLE = {
    "ix_time_series_hour": _series("hour"),
    "ix_time_series_day": _series("day"),
    "ix_time_series_week": _series("week"),
    "ix_time_series_one": """select 'view' as ix_name, date_trunc('hour', ts) as period, count(*) as calls from events
        where event_type = 'view' and ts between timestamp '2024-01-03' and timestamp '2024-01-20 12:00:00' group by 1, 2""",
    "tx_lookup": f"select * from {_TXS} where signature = 77",
    "ix_list_filtered": f"""select * from {_CALLS} where ix_name = 'click' and slot between 1 and 1000000000
        and created_at between timestamp '2024-01-02' and timestamp '2024-01-30' order by created_at desc limit 50 offset 10""",
    "ix_list_by_tx": f"select * from {_CALLS} where tx_sig = 42",
    "ix_list_page_cap": f"select * from {_CALLS} order by created_at desc limit 1000",
    "ix_list_large_page": f"select * from {_CALLS} order by created_at desc limit 5000",
    "ix_list_seek": f"select * from {_CALLS} order by created_at desc, slot desc, tx_sig limit 40 offset 400",
    "ix_filter_all_matching": f"""select * from {_CALLS} where slot >= 1 and created_at >= timestamp '2024-01-01'
        and created_at <= timestamp '2024-01-29 23:59:59'""",
    "ix_rows_json": """select event_id as tx_sig, cast(to_json({tx_sig: event_id, ix_name: event_type, user_id: user_id,
        k: cast(json_extract_string(props, '$.k') as integer)}) as varchar) as row from events""",
    "ix_call_count": "select count(*) as calls from events",
    "account_get_latest": f"select * from {_ACCOUNTS} where address = 8 order by slot desc limit 1",
    "account_history": f"select * from {_ACCOUNTS} where address = 8 order by slot desc limit 20",
    "account_list_latest": f"select distinct on (address) * from {_ACCOUNTS} order by address, slot desc",
    "account_history_topk": f"""select *, row_number() over (partition by address order by slot desc) as rn from {_ACCOUNTS} qualify rn <= 20""",
    "account_rows_json": f"""select address, slot, lamports, cast(to_json({{event_type: event_type, k: k}}) as varchar) as data from {_ACCOUNTS}""",
    "program_stats_tx": f"select count(*) as total_transactions, min(slot) as first_indexed_slot, max(slot) as last_indexed_slot from {_TXS}",
    "program_stats_ix": """select coalesce(event_type, '__total__') as "table", count(*) as calls from events group by rollup(event_type)""",
    "program_stats_overview": f"""select (select count(*) from orders) as total_transactions, (select count(*) from events) as total_ix_calls,
        (select '{{' || string_agg('"ix_' || event_type || '":' || n, ',' order by event_type) || '}}' from (select event_type, count(*) as n from events group by 1)) as ix_call_counts,
        (select min(slot) from {_TXS}) as first_indexed_slot, (select max(slot) from {_TXS}) as last_indexed_slot, 'tip' as last_checkpoint""",
    "tx_keep_first": f"select * from {_TWO_ATTEMPTS} qualify row_number() over (partition by o_orderkey order by seq) = 1",
    "account_keep_last": f"select * from {_TWO_ATTEMPTS} qualify row_number() over (partition by o_orderkey, slot order by seq desc) = 1",
    "ix_keep_first": """select l_orderkey, l_returnflag, min(cast(l_linenumber as bigint) * 1000000 + l_partkey) as ix_index
        from lineitem group by 1, 2""",
    "tx_insert_conflict": f"select signature, slot, cast(case when err is null then 2 else 1 end as bigint) as batch from {_TXS}",
    "tx_insert_far_conflict": f"""select cast(signature as varchar) as signature,
        case when signature % 2 = 1 then slot else slot + 5000 end as slot from {_TXS}""",
    "checkpoint_state": """select event_type as key, cast(arg_max(user_id, event_id) as varchar) as value from events group by 1""",
    "typed_coercion": """select event_id, case when user_id % 2 = 0 then event_id end as amount, user_id % 256 <> 0 as "on", true as memo,
        case when user_id % 2 = 0 then '' else 'does_not_fit' end as issues from events""",
    "evolve_add_column": f"""select o_orderkey, cast(date_diff('day', date '1970-01-01', cast(o_orderdate as date)) as bigint) as slot,
        case when o_orderstatus <> 'F' then o_orderpriority end as o_orderpriority,
        cast(case when o_orderstatus = 'F' then 0 else 1 end as bigint) as batch_id from orders""",
    "snake_case_names": f"""select name, {_snake('name')} as snake, {_column('name')} as column_name,
        'ix_' || {_snake('name')} as ix_table, 'acc_' || {_snake('name')} as acc_table from {_NAMES}""",
    "discriminators": f"select name, substr(sha256('global:' || name), 1, 16) as ix_disc, substr(sha256('account:' || name), 1, 16) as acc_disc from {_NAMES}",
    "registry_entries": _REGISTRY,
    "registry_address_check": """select case when c_custkey % 3 = 0 then 'Foreign' else 'P' || c_custkey end as program_id,
        case when c_acctbal > 5000 then 'P' || c_custkey end as address, c_custkey % 3 <> 0 or not c_acctbal > 5000 as accepted from customer""",
    "schema_introspection": f"""select program_id, program_name, kind, name, table_name,
        case when kind = 'account' then 'OwnerKey:publicKey,order:u64,' || (select any_value(c_mktsegment) from customer where 'P' || c_custkey = r.program_id) || ':bool'
             when ordinal = 0 then 'amountIn:u64,slot:u32' else 'amountIn:u64' end as fields
        from ({_REGISTRY}) r where has_table""",
    "latest_n": f"select signature, slot from {_TXS} order by slot desc, tx_index desc limit 100",
    "signature_page": f"""with c as (select max((slot, tx_index)) as newer, min((slot, tx_index)) as older from {_TXS} where signature in (500, 100))
        select signature, slot from {_TXS}, c where (slot, tx_index) < newer and (slot, tx_index) > older order by slot desc, tx_index desc limit 1000""",
    "backfill_since": f"""with c as (select slot as cs, tx_index as ct from {_TXS} where signature = 100)
        select signature, slot from {_TXS}, c where slot > cs or (slot = cs and tx_index > ct)""",
    "signature_list": f"""select cast(signature as varchar) as signature, slot, cast(case signature when 9 then 0 when 3 then 1 when 12 then 2 else 3 end as bigint) as list_order
        from {_TXS} where signature in (9, 3, 12, 700, 99999999)""",
    "chunk_progress": f"""with b as (select min(slot) as lo, max(slot) + 25 as hi from {_TXS}),
        c as (select unnest(range(0, (hi - lo) // 10 + 1)) as chunk, lo, hi from b),
        n as (select (slot - lo) // 10 as chunk, count(*) as found from {_TXS}, b group by 1)
        select c.chunk, lo + c.chunk * 10 as slot_start, least(lo + (c.chunk + 1) * 10 - 1, hi) as slot_end, coalesce(found, 0) as found
        from c left join n on c.chunk = n.chunk""",
    "program_filter_scan": f"select signature, slot, slot * 86400 as block_time from {_LINES}",
    "loaded_accounts": f"""select signature, cast(u.pos - 1 as bigint) as pos, u.address from (
          select signature, unnest(list_zip(range(1, 5), ['order' || l_orderkey, 'supp' || l_suppkey, 'SampleProgram', 'part' || l_partkey])) as z from {_LINES}) s,
        lateral (select z[1] as pos, z[2] as address) u""",
    "account_roles": """select event_id, cast(event_id % 4 as varchar) as pubkey, event_id % 4 < 2 as is_signer,
        case when event_id % 4 < 2 then event_id % 4 < 1 else event_id % 4 - 2 < greatest(0, event_id % 5 + 3 - 2 - 1) end as is_writable
        from events where event_id % 4 < event_id % 5 + 3""",
    "touched_accounts_first_slot": """select l_suppkey as address, arg_min(l_orderkey, cast(l_linenumber as bigint) * 10000000000000 + l_partkey * 10000000 + l_orderkey) as slot
        from lineitem group by 1""",
    "touched_account_snapshots": """select l_suppkey as address, min(cast(date_diff('day', date '1970-01-01', cast(l_shipdate as date)) as bigint)) as slot,
        any_value(cast(round(s_acctbal * 100) as bigint)) as lamports, any_value(s_name) as data from lineitem join supplier on s_suppkey = l_suppkey group by 1""",
    "account_snapshots_as_of": """with l as (select l_partkey as address, cast(date_diff('day', date '1970-01-01', cast(l_shipdate as date)) as bigint) as slot,
            cast(l_quantity as bigint) as lamports, l_returnflag as data from lineitem),
        t as (select address, min(slot) as slot from l where data = 'R' group by 1),
        v as (select address, slot, max(lamports) as lamports, max(data) as data from l group by 1, 2)
        select t.address, t.slot, v.lamports, v.data from t join v on v.address = t.address and v.slot <= t.slot
        qualify row_number() over (partition by t.address order by v.slot desc) = 1""",
    "route_counts": """select case when event_type in ('click', 'purchase', 'view') then event_type end as entry_name,
        case when event_type in ('click', 'purchase') then 'ix_' || event_type end as table_name, count(*) as calls from events group by 1, 2""",
    "unknown_discriminator": """select substr(sha256('global:' || event_type), 1, 16) as discriminator_hex, count(*) as calls from events
        where event_type not in ('click', 'purchase', 'view') group by 1""",
    "quarantined_calls": """select event_id as tx_sig, substr(sha256('global:' || event_type), 1, 16) as discriminator_hex,
        case when event_type = 'view' then 'no_table' else 'unknown_discriminator' end as reason from events where event_type not in ('click', 'purchase')""",
    "borsh_round_trip": _ROUND_TRIP,
    "borsh_round_trip_native": _ROUND_TRIP,
    "decode_one_column": "select event_id as tx_sig, event_id from events",
    "decode_scalars": _SCALARS,
    "decode_scalars_native": _SCALARS,
    "decode_nested": _NESTED,
    "decode_nested_native": _NESTED,
    "decode_wide_integers": _WIDE,
    "decode_wide_integers_native": _WIDE,
    "decode_short_lists": _SHORT,
    "decode_short_lists_native": _SHORT,
    "decode_opaque": "select doc_id, md5(lower(hex(encode(text)))) as digest from documents",
    "decode_text_lists": "select conv_id, turn, text, cast(len(string_split(text, ' ')) as bigint) as n_words from conversations",
    "decode_nameless": """select event_id, '{"number":' || event_id || ',"odd":' || (user_id % 2 = 1) || '}' as args from events""",
    "decode_documents": "select doc_id, md5(text) as digest, n_chars from documents",
    "truncated_payloads": """with e as (select event_id, user_id, user_id % 13 as n from events),
        f as (select *, n >= 8 as has_big, case when n >= 8 then n - 8 else n end as left_over from e),
        g as (select *, left_over >= 4 as has_mid, case when left_over >= 4 then left_over - 4 else left_over end as rest from f),
        bytes as (select *, [(event_id // cast(pow(256, i) as bigint)) % 256 for i in range(8)] as b from g)
        select event_id, case when has_big then event_id end as big,
          case when has_mid and has_big then user_id when has_mid then b[1] + 256 * b[2] + 65536 * b[3] + 16777216 * b[4] end as mid,
          case when rest < 1 then null when has_big and has_mid then true
               when has_big then user_id % 256 <> 0 when has_mid then b[5] <> 0 else b[1] <> 0 end as tiny,
          'truncated' as issues from bytes""",
    "base58_round_trip": "select event_id, sha256(cast(event_id as varchar)) as key_hex, true as short_enough from events",
    "index_build_stats": _STATS,
    "index_calls": f"""select ix_name, signature as tx_sig, slot, slot * 86400 as block_time, l_partkey as part_key, cast(l_quantity as bigint) as quantity,
        cast(round(l_extendedprice * 100) as bigint) as price_cents from {_LINES}""",
    "index_accounts": f"""select 'supp' || s_suppkey as address, min(slot) as slot, any_value(cast(s_nationkey as bigint)) as lamports,
        any_value(sha256(s_name)) as owner_hex, any_value(cast(round(s_acctbal * 100) as bigint)) as balance_cents,
        any_value(s_acctbal > 0) as active, any_value(s_name) as label from supplier join {_LINES} on l_suppkey = s_suppkey group by s_suppkey""",
    "index_chain_time_series": f"""select 'newLine' as ix_name, cast(date_trunc('week', timestamp '1970-01-01' + slot * interval 1 day) as timestamp) as period,
        count(*) as calls from {_LINES} where ix_name = 'newLine' group by 1, 2""",
    "index_range_resumed": _STATS,
    "index_signature_list": """select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity as integer)) as signature,
        cast(date_diff('day', date '1970-01-01', cast(l_shipdate as date)) as bigint) as slot,
        case l_linestatus when 'O' then 1 else 0 end as calls from lineitem where l_orderkey between 1 and 40""",
    "index_point_lookup": f"""with line as (select signature, slot, l_suppkey from {_LINES} order by signature limit 1),
        states as (select 'supp' || l_suppkey as key, min(slot) as slot from {_LINES} where l_suppkey = (select l_suppkey from line) group by 1)
        select 'transaction' as kind, signature as key, slot from line union all select 'call', signature, slot from line
        union all select 'account', key, slot from states union all select 'version', key, slot from states""",
    "index_range_time_series": f"""select 'newLine' as ix_name, cast(timestamp '1970-01-01' + slot * interval 1 day as timestamp) as period, count(*) as calls
        from {_LINES} where ix_name = 'newLine' and slot between date_diff('day', date '1970-01-01', date '1997-03-01') and date_diff('day', date '1970-01-01', date '1997-03-31') group by 1, 2""",
    "index_current_states": f"""select 'supp' || s_suppkey as address, coalesce(min(slot) filter (slot >= 9600), min(slot)) as slot,
        any_value(cast(s_nationkey as bigint)) as lamports, any_value(s_name) as label from supplier join {_LINES} on l_suppkey = s_suppkey group by s_suppkey""",
    "index_failed_left_out": f"""select include_failed, case when l_quantity > 40 then 'LineFailed' end as err, count(*) as transactions, min(slot) as first_slot
        from {_LINES}, (values (true), (false)) as v(include_failed) where include_failed or l_quantity <= 40 group by 1, 2""",
    "index_rewritten_stats": _STATS,
    "stream_index_counts": _STATS,
    "stream_time_series": _series("day"),
    "stream_row_bound": f"""with recursive slots as (select slot, count(*) as n, row_number() over (order by slot) as i from {_LINES} group by slot),
        bound as (select (sum(n) + 2) // 3 as most from slots),
        cut as (select i, slot, n, 1 as part, n as held from slots where i = 1
          union all
          select s.i, s.slot, s.n, case when c.held + s.n > most then c.part + 1 else c.part end, case when c.held + s.n > most then s.n else c.held + s.n end
          from cut c join slots s on s.i = c.i + 1, bound)
        select min(slot) as first_slot, max(slot) as last_slot, cast(sum(n) as bigint) as transactions from cut group by part""",
    "stream_catch_up": _STATS,
}
