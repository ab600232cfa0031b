"""Snapshot differences, contributions, rollups, table maintenance and paging."""
