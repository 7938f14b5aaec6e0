"""The case tables stated in SQL, for the result checks."""

INV = """
select printf('CASE-%04d', l_suppkey) as tenant_id,
  row_number() over (partition by l_suppkey order by l_orderkey,l_linenumber,l_partkey,l_quantity,l_extendedprice,
                     l_discount,l_tax,l_shipdate,l_returnflag,l_linestatus) as seq,
  o_custkey as buyer_key, l_partkey as part_key,
  printf('AB%08d', l_orderkey*10+l_linenumber) as invoice_number,
  cast(20000000+(l_suppkey*7919)%79999999 as varchar(20)) as seller_ban,
  case when l_orderkey%97=0 then cast(20000000+(l_suppkey*7919)%79999999 as varchar(20))
       else cast(20000000+(o_custkey*104729)%79999999 as varchar(20)) end as buyer_ban,
  printf('Customer#%09d', o_custkey) as buyer_name,
  cast(l_extendedprice as decimal(18,2)) as sales_amount,
  cast(round(cast(l_extendedprice as decimal(18,2))*cast(l_tax as decimal(4,2)),0) as decimal(18,2)) as tax_amount,
  cast(cast(l_extendedprice as decimal(18,2))
       + round(cast(l_extendedprice as decimal(18,2))*cast(l_tax as decimal(4,2)),0)
       + case when l_quantity>49 then 1000 else 0 end as decimal(18,2)) as total_amount,
  cast(l_shipdate as date) as invoice_date,
  case l_partkey%4 when 0 then 30 when 1 then 60 when 2 then 90 else 45 end as payment_terms_days,
  cast(l_shipdate as date) + cast(case l_partkey%4 when 0 then 30 when 1 then 60 when 2 then 90 else 45 end
       + case when l_linenumber=7 then 5 else 0 end as int) as due_date,
  case when l_linestatus='F' and l_returnflag in ('A','R') then 'PAID' when l_linestatus='F' then 'WRITTEN_OFF'
       when l_returnflag='N' then 'VOID' else 'PENDING' end as status,
  case when l_linestatus='F' and l_returnflag in ('A','R')
       then cast(l_shipdate as date) + cast(30 + l_partkey%40 as int) end as paid_date
from lineitem join orders on l_orderkey=o_orderkey"""

CON = """
select tenant_id, 1 as seq, concat('CT', buyer_ban) as contract_number, buyer_ban,
  printf('Customer#%09d', min(buyer_key)) as buyer_name,
  cast(30+30*(min(buyer_key)%3) as int) as payment_terms_days,
  date '1996-01-01' + cast(min(buyer_key)%700 as int) as effective_date,
  date '1999-01-01' as expiry_date,
  cast(100000+1000*(min(buyer_key)%50) as decimal(18,2)) as annual_commitment_amount
from inv where buyer_key%3=0 group by tenant_id, buyer_ban"""

LED = """
select tenant_id, led_seq as seq, txn_date, reference, amount,
  cast(850000 + sum(amount) over (partition by tenant_id order by led_seq rows between unbounded preceding and current row)
       + case when led_seq%97=0 then 500 else 0 end as decimal(18,2)) as balance
from (select tenant_id, paid_date as txn_date, total_amount as amount,
        case when part_key%5=0 then '' else invoice_number end as reference,
        row_number() over (partition by tenant_id order by paid_date, seq) as led_seq
      from inv where status='PAID' and part_key%11<>0) x"""

BIL = """
select printf('CASE-%04d', o_custkey%100) as tenant_id, o_orderkey as seq,
  printf('AP%08d', o_orderkey) as bill_number,
  cast(20000000+((o_custkey%100)*7919)%79999999 as varchar(20)) as buyer_ban,
  cast(20000000+(o_custkey*104729)%79999999 as varchar(20)) as supplier_ban,
  printf('Customer#%09d', o_custkey) as supplier_name,
  cast(o_totalprice as decimal(18,2)) as amount,
  cast(o_orderdate as date) + cast(15+15*(o_orderkey%3) as int) as due_date,
  case when o_orderstatus='F' then 'PAID' else 'PENDING' end as status
from orders"""

_CTE = {"inv": INV, "con": CON, "led": LED, "bil": BIL}


def with_tables(*names: str, extra: str = "") -> str:
    """``WITH`` clause for the named case tables (``inv`` is added where another needs it)."""
    need = [n for n in _CTE if n in names or (n == "inv" and {"con", "led"} & set(names))]
    parts = [f"{n} as materialized ({_CTE[n]})" for n in need]
    if extra:
        parts.append(extra)
    return "with " + ",\n".join(parts) + "\n"
