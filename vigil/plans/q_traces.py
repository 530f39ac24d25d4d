"""§2.14 conversation / trace queries on ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import profile as pr
from vigil.operators import traces as tr
from vigil.plans.registry import query
from vigil.sources.readers import table

_TOK = "len(list_filter(string_split_regex(trim({t}), '\\s+'), lambda x: x <> ''))"


def _tok(t):
    return _TOK.format(t=t)


@query("trace_timeline", f"""SELECT conv_id, turn, role, {_tok('text')} AS n_tokens,
  lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev_role,
  CAST(sum({_tok('text')}) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum_tokens
FROM conversations""")
def q_trace_timeline(spark, sf):
    return tr.timeline(table(spark, sf, "conversations"))


@query("trace_latency_tokens", f"""SELECT conv_id, count(*) AS n_turns, CAST(sum({_tok('text')}) AS BIGINT) AS n_tokens,
  CAST(coalesce(sum({_tok('text')}) FILTER (WHERE role = 'user'), 0) AS BIGINT) AS user_tokens,
  CAST(coalesce(sum({_tok('text')}) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS assistant_tokens,
  count(*) FILTER (WHERE role = 'assistant' AND {_tok('text')} = 0) AS n_empty_responses
FROM conversations GROUP BY conv_id""")
def q_trace_latency_tokens(spark, sf):
    return tr.totals(table(spark, sf, "conversations"))


@query("trace_eval_rules", f"""WITH t AS (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS)
  OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prompt FROM conversations),
a AS (SELECT *, list_distinct(list_filter(string_split_regex(trim(lower(text)), '\\s+'), lambda x: x <> '')) AS rt,
  list_distinct(list_filter(string_split_regex(trim(lower(prompt)), '\\s+'), lambda x: x <> '')) AS pt
  FROM t WHERE role = 'assistant' AND prompt IS NOT NULL)
SELECT conv_id, turn, {_tok('text')} AS response_tokens, {_tok('prompt')} AS prompt_tokens,
  round(CAST({_tok('text')} AS DOUBLE) / nullif({_tok('prompt')}, 0), 9) AS length_ratio,
  round(CAST(len(list_intersect(rt, pt)) AS DOUBLE) / nullif(len(rt), 0), 9) AS overlap FROM a""")
def q_trace_eval_rules(spark, sf):
    return tr.response_checks(table(spark, sf, "conversations"))


@query("prompt_dataset_version", """WITH o AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'),
n AS (SELECT conv_id, turn, regexp_replace(text, ' +', ' ', 'g') AS text FROM conversations WHERE role = 'user')
SELECT change, count(*) AS n_rows FROM (SELECT CASE WHEN o.conv_id IS NULL THEN 'added' WHEN n.conv_id IS NULL THEN 'removed'
  WHEN o.text IS NOT DISTINCT FROM n.text THEN 'unchanged' ELSE 'changed' END AS change
  FROM o FULL OUTER JOIN n ON o.conv_id = n.conv_id AND o.turn = n.turn) GROUP BY change""")
def q_prompt_dataset_version(spark, sf):
    """Prompt dataset v1 (raw user turns) vs v2 (whitespace-normalised)."""
    c = table(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", "text")
    v2 = c.withColumn("text", F.regexp_replace("text", " +", " "))
    return pr.dataset_diff(c, v2, ["conv_id", "turn"])
