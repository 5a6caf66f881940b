"""Log-template analytics on Spark: lines to templates, templates to groups, groups to compact reports."""
