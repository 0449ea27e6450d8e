"""floorledger: floor-plan, site and change-list analytics as Spark DataFrame jobs."""
