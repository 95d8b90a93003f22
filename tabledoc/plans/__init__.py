"""The SQL passage and the registered queries."""


def load_all():
    """Import every query module and return the registry."""
    from importlib import import_module

    from tabledoc.plans.registry import QUERIES

    for module in (
        "sql_families", "tables", "pages", "texts", "chats", "scores", "streams",
    ):
        import_module(f"tabledoc.plans.{module}")
    return QUERIES
