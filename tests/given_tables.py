"""Where the given tables are; a module of its own, as more than one folder has a conftest."""

SMALL = "/root/testdata/sf0.001"
