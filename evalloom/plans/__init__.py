"""Plan shapes shared by the operators, and the named queries bound to the test tables."""
