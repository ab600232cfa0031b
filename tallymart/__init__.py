"""Statistics mart of resolved entities: tables, signed changes, four reports and paged lists, as DataFrame operators."""
