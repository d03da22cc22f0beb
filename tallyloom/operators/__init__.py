"""The operators: mining, rules, redundancy, recommendation, splits, stability, back-test, segments and graphs."""
