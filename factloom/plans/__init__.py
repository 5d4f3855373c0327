"""Query plans of the driver contract."""


def load_catalogue():
    """All registered queries and their SQL twins."""
    from . import catalogue, findings_queries, operator_queries, relation_queries, rule_queries, verdict_queries  # noqa: F401

    return catalogue.QUERIES, catalogue.SQL
