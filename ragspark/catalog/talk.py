"""Conversation memory and chat-log transcripts."""

from pyspark.sql import functions as F

from ragspark.catalog import common as C
from ragspark.functions import text as X
from ragspark.operators import dialogue, memory
from ragspark.plans import flows
from ragspark.session import shared_folder
from ragspark.sources import files

QUERIES, ORACLE = {}, {}
# Folders over which the written chat logs are dealt.
LOG_FOLDERS = 256


def messages(spark, folder):
    return C.table(spark, folder, "conversations").select(
        F.col("conv_id").alias("invoke_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content")
    )


SQL_MESSAGE = "message AS (SELECT conv_id AS invoke_id, turn AS seq, role, text AS content FROM conversations)"


def sql_window(n, chars):
    return f"""
WITH {SQL_MESSAGE},
numbered AS (
  SELECT *, row_number() OVER w AS rn, sum(length(content)) OVER w AS total FROM message WHERE role <> 'assistant'
  WINDOW w AS (PARTITION BY invoke_id ORDER BY seq DESC)),
kept AS (SELECT * FROM numbered WHERE rn = 1 OR (rn <= {n} AND total <= {chars}))
"""


LINE = "CASE WHEN role = 'user' THEN '사용자' ELSE 'AI' END || ': ' || substring(content, 1, 200)"

QUERIES.update(
    history_window=lambda s, d: memory.history_window(messages(s, d)),
    history_window_tight=lambda s, d: memory.history_window(messages(s, d), 3, 400),
    recent_summary_text=lambda s, d: memory.recent_summary_text(messages(s, d), 2),
    last_user_message=lambda s, d: memory.last_message(messages(s, d)),
    history_line=lambda s, d: messages(s, d).select(
        "invoke_id", "seq", X.history_line(F.col("role"), F.col("content")).alias("line")
    ),
    trim_history=lambda s, d: memory.trim_history(
        C.table(s, d, "events"), key="user_id", order="event_id"
    ).select("user_id", "event_id"),
    live_rows=lambda s, d: memory.live_rows(
        C.table(s, d, "events"), F.lit("2024-01-20").cast("timestamp"), written_at="ts"
    ).select("event_id", "user_id"),
    accumulate_or_reset=lambda s, d: memory.accumulate_or_reset(
        C.table(s, d, "events").select(
            "user_id", "event_id",
            F.when(F.col("event_type") == "error", F.array().cast("array<string>"))
            .otherwise(F.array("event_type", "props")).alias("items"),
        ),
        "user_id", "event_id",
    ),
)
ORACLE.update(
    history_window=sql_window(5, 2500) + "SELECT invoke_id, seq, role, content FROM kept",
    history_window_tight=sql_window(3, 400) + "SELECT invoke_id, seq, role, content FROM kept",
    recent_summary_text=sql_window(5, 2500) + f"""
SELECT m.invoke_id, coalesce(any_value(text), '') AS conversation FROM message m LEFT JOIN (
  SELECT invoke_id, string_agg({LINE}, chr(10) ORDER BY seq) AS text FROM kept WHERE rn <= 2 GROUP BY ALL) t
ON t.invoke_id = m.invoke_id GROUP BY m.invoke_id""",
    last_user_message=f"WITH {SQL_MESSAGE} SELECT invoke_id, arg_max(content, seq) AS content FROM message"
    " WHERE role = 'user' GROUP BY ALL",
    history_line=f"WITH {SQL_MESSAGE} SELECT invoke_id, seq, {LINE} AS line FROM message",
    trim_history="SELECT user_id, event_id FROM events"
    " QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 10",
    live_rows="SELECT event_id, user_id FROM events WHERE ts > TIMESTAMP '2024-01-13'",
    accumulate_or_reset="""
WITH u AS (SELECT *, max(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id) AS reset FROM events),
kept AS (SELECT * FROM u WHERE event_type <> 'error' AND (reset IS NULL OR event_id > reset))
SELECT user_id, event_id, 0 AS pos, event_type AS item FROM kept
UNION ALL SELECT user_id, event_id, 1, props FROM kept""",
)


def chat_log(spark, folder):
    """One log per user: talkers are event types, errors carry attachments, some stamps and talkers are blank."""
    text = F.when(F.col("event_type") == "error", F.concat(F.lit("ATTACH://"), "props")).otherwise(
        F.concat(F.lit("<FONT size=2>"), "props", F.lit("</FONT>"))
    )
    return C.table(spark, folder, "events").select(
        F.col("user_id").alias("file"), F.col("event_id").alias("row_seq"),
        F.when(F.col("event_id") % 11 == 0, F.lit(" ")).otherwise(F.col("event_type")).alias("sTalkerName"),
        F.when(F.col("event_id") % 13 == 0, F.lit("")).otherwise(
            F.date_format("ts", "yyyy-MM-dd HH:mm")
        ).alias("formatted_date"),
        F.when(F.col("event_id") % 17 == 0, F.lit("<FONT>")).otherwise(text).alias("sTalkerContent"),
        F.when(F.col("event_id") % 3 == 0, F.lit("")).otherwise(F.lit("scan.pdf")).alias("sOriginalFileName"),
    )


def written_log(spark, folder):
    """The same logs as CSV files, one per user, with quotes, commas and line ends inside fields."""
    path = shared_folder(spark, "chat-logs")
    made = chat_log(spark, folder).withColumns(
        {
            "sTalkerContent": F.concat("sTalkerContent", F.lit(' "가", \n'), F.col("row_seq").cast("string")),
            "formatted_date": F.coalesce("formatted_date", F.lit("")), "row_seq": F.col("row_seq").cast("string"),
        }
    )
    # folders of many logs: one per log would be listed one by one
    place = F.coalesce(F.pmod("file", F.lit(LOG_FOLDERS)), F.lit(0)).cast("string")
    name = F.concat(F.lit("bin="), place, F.lit("/"), F.coalesce(F.col("file").cast("string"), F.lit("none")), F.lit(".csv"))
    files.write_chat_csv(made.withColumn("file", name), path)
    return path


def file_transcripts(spark, folder):
    """Transcripts read back from the files."""
    user = F.regexp_extract("file", "(?:/|%2F)(-?[0-9]+|none)[.]csv(?:/|$)", 1).try_cast("long")
    return flows.dialogue_transcripts(spark, written_log(spark, folder)).select(user.alias("file"), "row_seq", "kind", "line")


SQL_LOG = """
WITH log AS (
  SELECT user_id AS file, event_id AS row_seq,
    CASE WHEN event_id % 11 = 0 THEN '' ELSE event_type END AS talker,
    CASE WHEN event_id % 13 = 0 THEN '' ELSE strftime(ts, '%Y-%m-%d %H:%M') END AS stamp,
    event_type = 'error' AND event_id % 3 <> 0 AND event_id % 17 <> 0 AS att,
    CASE WHEN event_id % 17 = 0 THEN '' WHEN event_type = 'error' AND event_id % 3 <> 0 THEN '[첨부파일: scan.pdf]'
      WHEN event_type = 'error' THEN 'ATTACH://' || props ELSE props || '</FONT>' END AS text
  FROM events),
kept AS (
  SELECT *, nullif(split_part(stamp, ' ', 1), '') AS day, split_part(stamp, ' ', 2) AS tm FROM log WHERE text <> ''),
seen AS (
  SELECT *, lag(talker) OVER w AS p_talker, lag(att) OVER w AS p_att,
    last_value(day IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p_day
  FROM kept WINDOW w AS (PARTITION BY file ORDER BY row_seq)),
marked AS (
  SELECT *, day IS NOT NULL AND day IS DISTINCT FROM p_day AS new_date,
    (day IS NOT NULL AND day IS DISTINCT FROM p_day) OR p_talker IS NULL OR talker <> p_talker OR att OR p_att AS new_run
  FROM seen),
runs AS (SELECT *, sum(new_run::INT) OVER (PARTITION BY file ORDER BY row_seq) AS run FROM marked)
"""

QUERIES.update(
    clean_content=lambda s, d: chat_log(s, d).select(
        "row_seq", X.clean_content(F.col("sTalkerContent"), F.col("sOriginalFileName")).alias("c")
    ).select("row_seq", "c.text", "c.is_attachment"),
    split_stamp=lambda s, d: chat_log(s, d).select(
        "row_seq", X.stamp_date(F.col("formatted_date")).alias("day"), X.stamp_time(F.col("formatted_date")).alias("time")
    ),
    dialogue_runs=lambda s, d: dialogue.dialogue_runs(chat_log(s, d), rows_per_piece=1000),
    date_headers=lambda s, d: dialogue.dialogue_rows(chat_log(s, d), rows_per_piece=1000)
    .where("new_date").select("file", "row_seq", "date", "later_date"),
    dialogue_transcripts=lambda s, d: dialogue.dialogue_lines(chat_log(s, d)),
    dialogue_run_texts=lambda s, d: dialogue.run_texts(chat_log(s, d), 1000, 60),
    file_transcripts=file_transcripts,
)
SQL_LINES = """
SELECT file, SEQ AS row_seq, 0 AS kind, CASE WHEN p_day IS NULL THEN '' ELSE chr(10) END || '===== ' || day || ' =====' AS line
FROM marked WHERE new_date
UNION ALL
SELECT file, SEQ, 1, CASE WHEN NOT new_run THEN text WHEN tm = '' THEN talker || ': ' || text
  ELSE '[' || tm || '] ' || talker || ': ' || text END
FROM marked WHERE talker <> ''"""
SQL_FILES = SQL_LOG.replace(
    "props ELSE props || '</FONT>' END AS text", "props || more ELSE props || '</FONT>' || more END AS text"
).replace("WHEN event_id % 17 = 0 THEN ''", "WHEN event_id % 17 = 0 THEN trim(more)").replace(
    "FROM events)", "FROM (SELECT *, ' \"가\", ' || chr(10) || event_id AS more FROM events))"
).replace("AS row_seq,", "AS row_seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n,", 1)

ORACLE.update(
    dialogue_run_texts=SQL_LOG + """,
placed AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY file, run ORDER BY row_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 60 AS part,
  min(row_seq) OVER (PARTITION BY file, run) AS first_row, first_value(tm) OVER (PARTITION BY file, run ORDER BY row_seq) AS time FROM runs)
SELECT file, first_row, part::BIGINT AS part, talker, time, string_agg(text, chr(10) ORDER BY row_seq) AS text FROM placed WHERE talker <> '' GROUP BY ALL""",
    file_transcripts=SQL_FILES + SQL_LINES.replace("SEQ", "n"),
    clean_content=SQL_LOG + "SELECT row_seq, text, att AS is_attachment FROM log",
    split_stamp=SQL_LOG + "SELECT row_seq, split_part(stamp, ' ', 1) AS day, split_part(stamp, ' ', 2) AS time FROM log",
    dialogue_runs=SQL_LOG + """
SELECT file, min(row_seq) AS first_row, arg_min(talker, row_seq) AS talker, arg_min(tm, row_seq) AS time,
  count(*) AS n_rows, sum(length(text))::BIGINT AS n_chars
FROM runs WHERE talker <> '' GROUP BY file, run""",
    date_headers=SQL_LOG + "SELECT file, row_seq, day AS date, p_day IS NOT NULL AS later_date FROM marked WHERE new_date",
    dialogue_transcripts=SQL_LOG + """
SELECT file, row_seq, 0 AS kind, CASE WHEN p_day IS NULL THEN '' ELSE chr(10) END || '===== ' || day || ' =====' AS line
FROM marked WHERE new_date
UNION ALL
SELECT file, row_seq, 1, CASE WHEN NOT new_run THEN text WHEN tm = '' THEN talker || ': ' || text
  ELSE '[' || tm || '] ' || talker || ': ' || text END
FROM marked WHERE talker <> ''""",
)
