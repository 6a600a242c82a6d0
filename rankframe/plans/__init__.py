"""Views over the driver's tables and the queries registered on them."""
