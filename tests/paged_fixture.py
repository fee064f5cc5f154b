"""A service of 12 rows in pages, some of them revisions."""

ROWS = [{"ticker": f"T{i % 4}", "settlement_date": None, "id": i % 9, "value": i} for i in range(12)]


def fetch(offset: int, limit: int, start: int = 0):
    rows = [r for r in ROWS if r["value"] >= start]
    return rows[offset : offset + limit] if offset < len(rows) else None
