"""Deterministic projections of the driver's tables into bibliographic records.

Each view is one SELECT in the dialect that Spark and DuckDB share; {name} stands for a table or an
earlier view."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from lectern import policy

_SOURCE = "CASE l_suppkey % 12 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(policy.TRUST_ORDER)) + " END"
_NAMES = ("Lovelace, Ada", "Grace Hopper", "van Rossum, Guido", "Erdős, Paul", "Maria de la Cruz", "O''Neil, Cathy", "Knuth DE", "Wei Li")


def _name(key: str) -> str:
    return f"CASE ({key}) % 8 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_NAMES)) + " END"


_JOURNALS = "CASE p_size % 16 WHEN 0 THEN 'Procedia Computer Science' WHEN 1 THEN 'Journal of Parts' WHEN 2 THEN 'Research Portal' WHEN 3 THEN 'Technical University' WHEN 4 THEN 'Proceedings of the Ring Conference' WHEN 5 THEN 'Proceedings of the VLDB Endowment' WHEN 6 THEN 'bioRxiv' WHEN 7 THEN 'Unpublished' WHEN 8 THEN 'US Patent 10,901' WHEN 9 THEN 'VLDB' WHEN 10 THEN 'DIGITAL HEALTH' WHEN 11 THEN 'Veterinary Sciences' WHEN 12 THEN 'Journal of http https://x.y/z' WHEN 13 THEN 'Annals of Bolts and...' WHEN 14 THEN 'arXiv' WHEN 15 THEN 'Handbook of Rings' END"
_BOOKTITLES = "CASE p_size % 16 WHEN 0 THEN 'PACM HCI' WHEN 1 THEN 'Proceedings of the IEEE' WHEN 2 THEN 'Proceedings of the IEEE Conference' WHEN 3 THEN 'Deep Blue Library' WHEN 4 THEN 'DSpace' WHEN 5 THEN 'Preprint' WHEN 6 THEN 'arXiv' WHEN 7 THEN 'Journal of Rings' WHEN 8 THEN 'Handbook of Bolts' WHEN 9 THEN 'https://a.b/c' WHEN 10 THEN 'Workshop , Rings  and' WHEN 12 THEN 'Ring Symposium, 12:1 - 12:9' WHEN 13 THEN 'Proceedings of the Extended Abstracts of X' WHEN 14 THEN 'Conference on Bolts -' WHEN 11 THEN 'Ring Symposium : SPIRE 2019, Proceedings' WHEN 15 THEN 'CEUR WORKSHOP PROCEEDINGS https://u.v' END"
_MARKS = "CASE p_size % 7 WHEN 0 THEN ' [Preprint]' WHEN 1 THEN ' [J]' WHEN 2 THEN ' -' WHEN 3 THEN ': -a b-' WHEN 4 THEN ' of the...' WHEN 5 THEN '' WHEN 6 THEN '' END"
_DOIS = "CASE (p_partkey + p_size) % 8 WHEN 0 THEN '10.48550/arxiv.2301.00001' WHEN 1 THEN '10.1101/2020.01' WHEN 2 THEN '10.1016/b.ch12' WHEN 3 THEN '10.31234/osf.io/ab_v2' WHEN 4 THEN '10.1145/1' WHEN 5 THEN '10.5281/zenodo.5' WHEN 6 THEN NULL WHEN 7 THEN NULL END"
_TITLE = "p_name || ' ' || lower(p_type)"
# authors of ten records each: their number grows with the table; three records in a row are versions of one work
_DIR = "'author-' || CAST(CAST(floor(p_partkey / 10) AS bigint) AS varchar(20))"
_ARXIV = r"""CASE WHEN lower(coalesce(#.archiveprefix, '')) = 'arxiv' THEN regexp_replace(trim(coalesce(#.eprint, '')), 'v[0-9]+$', '')
            WHEN regexp_extract(lower(coalesce(#.doi, '')), '10[.]48550/arxiv[.]([0-9][0-9][0-9][0-9][.][0-9][0-9][0-9][0-9][0-9]?)', 1) <> '' THEN regexp_extract(lower(coalesce(#.doi, '')), '10[.]48550/arxiv[.]([0-9][0-9][0-9][0-9][.][0-9][0-9][0-9][0-9][0-9]?)', 1)
            ELSE regexp_extract(coalesce(#.journal, #.howpublished, ''), '[aA][rR][xX][iI][vV]:[ ]*([0-9][0-9][0-9][0-9][.][0-9][0-9][0-9][0-9][0-9]?)', 1) END"""

VIEWS = {
    "v_records": f"""
        SELECT l_partkey AS work_id, (l_orderkey * 10 + l_linenumber) * 100000 + l_suppkey % 100 * 1000 + CAST(l_quantity AS int) * 10 + CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS seq, CAST(l_suppkey % 12 AS int) AS source_rank,
          {_SOURCE} AS source,
          CASE WHEN l_linestatus = 'O' THEN 'article' ELSE 'inproceedings' END AS type,
          CASE l_linenumber % 4 WHEN 0 THEN p_name || ' et al...' WHEN 1 THEN {_TITLE} || ' in detail' ELSE {_TITLE} END AS title,
          {_name('l_partkey')} || CASE WHEN l_linenumber % 2 = 0 THEN ' and ' || {_name('l_partkey + 1')} ELSE '' END AS author,
          CASE l_returnflag WHEN 'A' THEN '10.48550/arxiv.2301.' || lpad(CAST(l_partkey % 10000 AS varchar(9)), 5, '0')
            WHEN 'N' THEN '10.1145/' || CAST(l_partkey AS varchar(20)) || '.' || CAST(l_linenumber % 2 AS varchar(9)) ELSE NULL END AS doi,
          CAST(year(l_shipdate) AS varchar(9)) AS year,
          CASE WHEN l_quantity < 5 THEN 'n/a' ELSE CAST(CAST(l_quantity AS int) AS varchar(9)) END AS volume,
          CASE WHEN l_linenumber % 5 = 0 THEN 'online' ELSE CAST(l_linenumber * 10 AS varchar(9)) || '-' || CAST(l_linenumber * 10 + 9 AS varchar(9)) END AS pages,
          CASE WHEN l_linestatus = 'O' THEN CASE WHEN l_returnflag = 'A' AND l_linenumber = 1 THEN 'bioRxiv' ELSE 'Journal of ' || p_type END ELSE NULL END AS journal,
          CASE WHEN l_linestatus = 'F' THEN CASE WHEN l_linenumber % 3 = 0 THEN 'Lecture Notes in Computer Science' ELSE 'Proceedings of the ' || p_brand || ' Conference' END ELSE NULL END AS booktitle,
          'Publisher ' || CAST(l_suppkey % 7 AS varchar(9)) AS publisher
        FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey""",
    "v_files": f"""
        SELECT p_partkey AS id, {_DIR} AS dir, p_brand AS brand,
          {_DIR} || '/' || CAST(p_partkey AS varchar(20)) || '.bib' AS path,
          CASE WHEN p_size % 3 = 0 THEN 'misc' WHEN p_size % 3 = 1 THEN 'article' ELSE 'inproceedings' END AS type,
          'Key' || CAST(p_size % 10 AS varchar(9)) AS key,
          work || CASE WHEN p_partkey % 7 = 0 THEN ' revisited' WHEN p_partkey % 11 = 0 THEN ', a Study' ELSE '' END AS title,
          {_name('work_size')} || ' and ' || {_name('work_size + p_partkey % 2 + 1')} AS author,
          2015 + CAST((work_size + CASE WHEN p_partkey % 8 = 1 THEN 5 ELSE p_partkey % 2 END) % 10 AS int) AS year,
          CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 4 = 1 THEN '10.20944/preprints' || CAST(p_size AS varchar(9)) || '.v' || CAST(p_partkey % 3 AS varchar(9))
            WHEN p_size % 4 = 2 THEN '10.48550/arxiv.2301.' || lpad(CAST(p_size AS varchar(9)), 5, '0') ELSE '10.1016/j.' || CAST(p_size * 3 AS varchar(9)) END AS doi,
          CASE WHEN p_size % 3 = 1 THEN CASE WHEN p_size % 4 = 2 THEN 'arXiv' ELSE 'Journal of ' || p_type END ELSE NULL END AS journal,
          CASE WHEN p_size % 3 = 2 THEN 'Proceedings of the ' || p_brand || ' Workshop' ELSE NULL END AS booktitle,
          CASE WHEN p_size % 3 = 0 THEN 'Tech report' ELSE NULL END AS howpublished,
          CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS varchar(9)) ELSE NULL END AS volume,
          CASE WHEN p_partkey % 5 = 0 THEN 'S' || CAST(p_size % 6 AS varchar(9)) ELSE NULL END AS s2_id,
          CASE WHEN p_size % 5 = 1 THEN 'arXiv' ELSE NULL END AS archiveprefix,
          CASE WHEN p_size % 5 < 2 THEN '2301.' || lpad(CAST(work_size AS varchar(9)), 5, '0') || CASE WHEN p_size % 2 = 0 THEN 'v2' ELSE '' END ELSE NULL END AS eprint
        FROM {{part}} JOIN (SELECT p_partkey AS work_id, {_TITLE} AS work, p_size AS work_size FROM {{part}}) AS works
          ON work_id = p_partkey - CASE WHEN p_partkey > 3 THEN p_partkey % 3 ELSE 0 END""",
    "v_entries": f"""
        SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'article' WHEN 1 THEN 'inproceedings' WHEN 2 THEN 'misc' ELSE 'article' END AS type,
          CASE p_size % 7 WHEN 5 THEN upper(p_name || ' of the state-of-the-art (rings)') WHEN 6 THEN p_name || ':Ai- based Knowledgedriven -Iot:Rings pre- and post..' ELSE p_name || {_MARKS} END AS title,
          {_name('p_size')} || CASE p_size % 6 WHEN 0 THEN ' <a.b@c.org> and' WHEN 1 THEN ' And JOHN SMITH and anna de lee' WHEN 2 THEN ' and Shu FU and J. Doe' ELSE '' END AS author,
          CASE WHEN p_partkey % 4 IN (0, 3) THEN {_JOURNALS} ELSE NULL END AS journal,
          CASE WHEN p_partkey % 4 = 1 THEN {_BOOKTITLES} ELSE NULL END AS booktitle,
          CASE WHEN p_partkey % 4 = 2 THEN CASE p_size % 4 WHEN 0 THEN 'arxiv' WHEN 1 THEN 'Ring Workshop' WHEN 2 THEN '' ELSE 'openRxiv' END ELSE NULL END AS howpublished,
          {_DOIS} AS doi, CASE WHEN p_size % 9 = 0 THEN 'https://doi.org/10.31234/osf.io/ab_v2' ELSE NULL END AS url,
          CASE WHEN p_size % 3 = 0 THEN '12' ELSE NULL END AS volume, CASE p_size % 5 WHEN 0 THEN '1-9' WHEN 1 THEN 'online' ELSE NULL END AS pages,
          CASE p_size % 4 WHEN 0 THEN 'Journal of Parts' WHEN 1 THEN 'openRxiv' WHEN 2 THEN 'ACM' ELSE 'Schloss Dagstuhl - Leibniz-Zentrum fur Informatik' END AS publisher,
          CAST(NULL AS varchar(9)) AS school, CASE WHEN p_size % 7 = 0 THEN 'x' ELSE NULL END AS note, CASE WHEN p_size % 2 = 0 THEN '2301.00001' ELSE NULL END AS eprint
        FROM {{part}}""",
    "v_titles": """
        SELECT doc_id AS id, lang, regexp_extract(text, '^[^.\\n]*', 0) AS title FROM {documents}""",
    "v_log": """
        SELECT event_id, ts, user_id, event_type AS namespace, value, value > 20 AS ok, props FROM {events}""",
    "v_census": """
        SELECT c_custkey AS row_no, c_name AS name,
          CASE WHEN c_custkey % 9 = 0 THEN '' ELSE 'https://scholar.example.org/citations?user=U' || lpad(CAST(c_custkey % 97 AS varchar(9)), 11, '0') END AS scholar,
          CASE WHEN c_custkey % 4 = 0 THEN 'https://dblp.example.org/pid/' || CAST(c_nationkey AS varchar(9)) || '/' || CAST(c_custkey AS varchar(20)) ELSE '' END AS dblp,
          c_acctbal >= 0 AS enabled, CASE WHEN c_acctbal < 0 OR c_custkey % 50 = 0 THEN 'left' ELSE '' END AS reason
        FROM {customer}""",
    "v_articles": f"""
        SELECT o_orderkey AS id, o_custkey % 40 AS author_id, {_TITLE} AS title, {_name('o_custkey')} AS authors,
          CAST(year(o_orderdate) AS int) AS year, CASE o_orderstatus WHEN 'F' THEN 'scholar' WHEN 'O' THEN 'dblp' ELSE 'existing' END AS origin,
          CASE o_orderkey % 6 WHEN 0 THEN 'Journal of Parts ' || CAST(o_orderkey % 60 AS varchar(9)) || ' (' || CAST(o_orderkey % 12 AS varchar(9)) || '), ' || CAST(o_orderkey % 300 AS varchar(9)) || '-' || CAST(o_orderkey % 300 + 9 AS varchar(9)) || ', ' || CAST(year(o_orderdate) AS varchar(9))
            WHEN 1 THEN 'arXiv preprint arXiv:2301.' || lpad(CAST(o_orderkey % 100000 AS varchar(9)), 5, '0') || ', ' || CAST(year(o_orderdate) AS varchar(9))
            WHEN 2 THEN 'Annals of Bolts ' || CAST(o_orderkey % 60 AS varchar(9)) || ', 1-9, ' || CAST(year(o_orderdate) AS varchar(9))
            WHEN 3 THEN 'Proceedings of the Ring Conference, 5-8, ' || CAST(year(o_orderdate) AS varchar(9))
            WHEN 4 THEN 'US Patent 10,' || lpad(CAST(o_orderkey % 1000 AS varchar(9)), 3, '0') || ',713, ' || CAST(year(o_orderdate) AS varchar(9))
            ELSE 'Sage, ' || CAST(year(o_orderdate) AS varchar(9)) END AS publication
        FROM {{orders}} JOIN {{part}} ON o_orderkey % (SELECT count(*) FROM {{part}}) = p_partkey""",
    "v_pairs": f"""
        SELECT l.id AS lid, r.id AS rid, l.dir AS dir, l.key AS lkey, r.key AS rkey, l.title AS ltitle, r.title AS rtitle,
          l.author AS lauthor, r.author AS rauthor, l.year AS lyear, r.year AS ryear, l.doi AS ldoi, r.doi AS rdoi,
          l.journal AS ljournal, r.journal AS rjournal, l.s2_id AS ls2, r.s2_id AS rs2,
          coalesce(l.journal, l.booktitle, l.howpublished) AS lvenue, coalesce(r.journal, r.booktitle, r.howpublished) AS rvenue,
          {_ARXIV.replace('#', 'l')} AS larxiv, {_ARXIV.replace('#', 'r')} AS rarxiv
        FROM {{v_files}} l JOIN {{v_files}} r ON l.dir = r.dir AND l.id < r.id""",
}


def needed(sql: str) -> list[str]:
    """Views that `sql` needs, those first that others are built on."""
    out: list[str] = []
    for name in re.findall(r"\bv_\w+", sql):
        for x in [*needed(VIEWS[name]), name]:
            if x not in out:
                out.append(x)
    return out


def duck(sql: str) -> str:
    """`sql` for DuckDB with the views it names as common table expressions."""
    ctes = ", ".join(f"{v} AS ({re.sub(r'[{}]', '', VIEWS[v])})" for v in needed(sql))
    if not ctes:
        return sql
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table of the driver."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    parts = {x: view(spark, sf_dir, x) for x in set(re.findall(r"\{(\w+)\}", sql))}
    return spark.sql(sql.replace("'^[^.\\n]*'", "'^[^.\\\\n]*'"), **parts)
