"""Spark jobs for marketplace reviews, customer retention, sales and stock."""
