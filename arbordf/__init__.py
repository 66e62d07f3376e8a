"""Analytics on PySpark: hierarchies, currency conversion, annotations, views and catalogs in SQL."""
