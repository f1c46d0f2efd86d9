"""Where catalogs, contents, caches and reports come from and go to."""
