"""Framework roles from annotations and supertypes, as expressions over arrays of simple names in source order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Annotation and supertype names and the role each gives.
TYPE_ANNOTATIONS = {"RestController": "REST_CONTROLLER", "Controller": "CONTROLLER", "Service": "SERVICE", "Repository": "REPOSITORY", "Configuration": "CONFIGURATION", "Component": "COMPONENT", "Entity": "ENTITY", "WebServlet": "SERVLET", "WebFilter": "FILTER", "WebListener": "LISTENER"}
SERVLETS = ("HttpServlet", "GenericServlet")
FILTERS = ("Filter",)
LISTENERS = ("ServletContextListener", "HttpSessionListener", "ServletRequestListener")
REPOSITORIES = ("JpaRepository", "CrudRepository", "PagingAndSortingRepository", "Repository", "ReactiveCrudRepository", "MongoRepository")
METHOD_ANNOTATIONS = {"Scheduled": "SCHEDULED", "EventListener": "EVENT_LISTENER"} | dict.fromkeys(("JmsListener", "KafkaListener", "RabbitListener"), "MESSAGE_LISTENER") | dict.fromkeys(("GetMapping", "PostMapping", "PutMapping", "DeleteMapping", "PatchMapping", "RequestMapping", "HttpExchange", "GET", "POST", "PUT", "DELETE", "Path"), "HTTP_ENDPOINT")
SERVLET_METHODS = ("doGet", "doPost", "doPut", "doDelete", "service")


def _first_known(names: Column, table: dict[str, str]) -> Column:
    mapping = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.get(F.filter(F.transform(names, lambda n: F.try_element_at(mapping, n)), lambda r: r.isNotNull()), F.lit(0))


def type_role(annotations: Column, extended: Column, implemented: Column) -> Column:
    """The first annotation with a role; else by supertypes. Repository bases count in either list."""
    bases = {**dict.fromkeys(FILTERS, "FILTER"), **dict.fromkeys(LISTENERS, "LISTENER"), **dict.fromkeys(REPOSITORIES, "JPA_REPOSITORY")}
    simple = lambda a: F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda n: F.substring_index(n, ".", -1))
    return F.coalesce(
        _first_known(F.coalesce(annotations, F.array().cast("array<string>")), TYPE_ANNOTATIONS),
        _first_known(simple(extended), dict.fromkeys(SERVLETS, "SERVLET")),
        _first_known(simple(implemented), bases),
        _first_known(simple(extended), dict.fromkeys(REPOSITORIES, "JPA_REPOSITORY")),
    )


def method_role(annotations: Column, owner_role: Column, name: Column) -> Column:
    return F.coalesce(_first_known(F.coalesce(annotations, F.array().cast("array<string>")), METHOD_ANNOTATIONS), F.when((owner_role == "SERVLET") & name.isin(*SERVLET_METHODS), F.lit("HTTP_ENDPOINT")))
