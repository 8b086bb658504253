"""Sources: snapshots of responses, URL lists, archive indexes."""
