"""What the test modules share."""

def rows(table, companions=False):
    return [tuple(r) for r in table.ordered(companions).collect()]
