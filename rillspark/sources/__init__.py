"""Sources: files, generated rows, queries over JDBC, sockets, topics, change feeds and partitioned readers."""
