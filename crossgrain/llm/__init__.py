"""Training-data operators: chat formatting, tokenizing, classifiers, dedup, mixing, search, sharding.

Nothing outside this subpackage imports it. `queries.QUERIES` lists the registered queries and
`queries.ORACLE_SQL` the SQL that checks those that SQL can express.
"""
