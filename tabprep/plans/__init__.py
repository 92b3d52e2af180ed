"""Plan assembly: derived inputs, the query catalogue, the preprocessing plan,
model search and findings gathering."""
