"""What several operators of this subpackage share."""

#: Partitions a shuffle is cut into at most, whatever the table holds; a task then works off several groups in turn.
MOST_TASKS = 20_000
