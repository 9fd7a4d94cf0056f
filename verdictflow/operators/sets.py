"""Unions and the upsert of daily history rows."""


def union_distinct(existing, new):
    """Both tables without full-row duplicates; columns by name, NULL equal to NULL."""
    return existing.unionByName(new, allowMissingColumns=True).distinct()


def union_all(existing, new):
    return existing.unionByName(new, allowMissingColumns=True)


def history_upsert(history, new, overwrite_day=True):
    """History with the rows of a new run.

    Days present already are replaced, or kept when `overwrite_day` is off.
    """
    if overwrite_day:
        kept = history.join(new.select("date").distinct(), "date", "left_anti")
        return kept.unionByName(new)
    added = new.join(history.select("date").distinct(), "date", "left_anti")
    return history.unionByName(added)
