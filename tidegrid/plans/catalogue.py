"""All queries on the public test tables, and their SQL."""

from tidegrid.plans import q_learn, q_long, q_report, q_signal, q_stats, q_time

PARTS = (q_time, q_signal, q_stats, q_learn, q_long, q_report)
QUERIES = {name: query for part in PARTS for name, query in part.QUERIES.items()}
SQL = {name: sql for part in PARTS for name, sql in part.SQL.items()}
