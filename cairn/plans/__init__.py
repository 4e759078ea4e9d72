"""The registered queries, each with the SQL that says the same where SQL can."""


def registered() -> tuple[dict, dict[str, str]]:
    from . import facts, reviews, texts, warehouse

    queries, sql = {}, {}
    for m in (warehouse, facts, texts, reviews):
        queries |= m.QUERIES
        sql |= m.SQL
    return queries, sql
