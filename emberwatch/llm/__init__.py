"""Training-data operators (one module each) and their registered queries. Nothing outside imports this package."""
