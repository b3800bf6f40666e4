"""Every operator as a query over the test tables, next to the SQL that must give the same rows."""
